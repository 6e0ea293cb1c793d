"""Secret scanning: three fixed patterns, and a randomness test battery for what the patterns miss.

The battery looks at runs of at least ``MIN_RUN`` characters of ``[A-Za-z0-9+/_-]`` with their trailing ``=``, so a key glued to
its name by ``=`` is a run of its own. A run that mixes ``+`` or ``/`` with ``_`` or ``-`` fits no encoding; its maximal stretches over each
alphabet are tested instead, their p-values multiplied by how many there are, and the likeliest that don't overlap are kept. The narrowest encoding that holds all
of a run's characters is inferred (hexadecimal, base 32 of A-Z and 2-7, base 36, base 62, base 64; letters of one case and
digits alone are words and numbers, not encodings). Against that encoding's alphabet it takes

* the chi-squared statistic of uniformity,
* the number of runs of character classes (digit, lower, upper, sign),
* the lag-1 serial correlation of the characters' places in the alphabet.

A run is a candidate if none of the three speaks against randomness (each at ``VETO``). How unlikely ordinary text would be
to look as random gives its p-value: text draws letters unevenly and seldom changes class (``CLASS_CHANGE`` a character),
so it has a larger chi-squared and fewer class runs; signs between words and words' first capitals don't count. Benjamini-Hochberg at ``FALSE_DISCOVERY`` over all runs of all
documents decides, each p-value weighted by its length, as longer runs have more power; the histogram of p-values by
length that this takes has a fixed number of cells, whatever the input's size.

Defined cases: a null or empty text has no spans; an added span never overlaps one of the patterns'; an empty table gives no
rows; repeated rows each get their row; other columns, whatever their names, are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.llm.shared import Tidy, materialise, occupy, text_rows

# Fixed patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

MIN_RUN = 20
PADDING = 6  # base 32 has the most
RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{MIN_RUN - PADDING},}}={{0,{PADDING}}}")
VETO = 1e-4
CLASS_CHANGE = 0.08  # about twice what runs of joined words show, signs and first capitals left out
FALSE_DISCOVERY = 0.01
LENGTH_STEP, LENGTH_CELLS = 8, 16
P_STEP, P_CELLS = 10, 400  # tenths of a power of ten

# Encodings from narrow to wide: the characters, as a regex class, and how many.
ENCODINGS = (("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), 16), ("base32", re.compile(r"[A-Z2-7]+"), 32), ("base36", re.compile(r"[0-9a-z]+|[0-9A-Z]+"), 36), ("base62", re.compile(r"[0-9A-Za-z]+"), 62), ("base64", re.compile(r"[0-9A-Za-z+/]+|[0-9A-Za-z_-]+"), 64))
STRETCHES = tuple(re.compile(f"{chars}{{{MIN_RUN - PADDING},}}={{0,{PADDING}}}") for chars in ("[0-9a-f]", "[0-9A-F]", "[A-Z2-7]", "[0-9a-z]", "[0-9A-Z]", "[0-9A-Za-z]", "[0-9A-Za-z+/]", "[0-9A-Za-z_-]"))
CAPITAL = re.compile(r"[A-Z](?=[a-z])")
PLAIN = re.compile(r"[0-9]+|[a-z]+|[A-Z]+|[A-Z][a-z]+")


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi_upper(x: float, df: int) -> float:
    """Wilson and Hilferty's approximation."""
    c = 2 / (9 * df)
    return _upper(((max(x, 0) / df) ** (1 / 3) - (1 - c)) / math.sqrt(c))


def bare(run: str) -> str:
    """A run without padding, and without the dashes that only group hexadecimal digits."""
    body = run.rstrip("=")
    return body.replace("-", "") if re.fullmatch(r"[0-9a-f-]+|[0-9A-F-]+", body) else body


def encoding(body: str) -> tuple[str, int] | None:
    """Name and size of the narrowest alphabet that holds a bare run."""
    if not body or PLAIN.fullmatch(body):
        return None
    return next(((name, size) for name, form, size in ENCODINGS if form.fullmatch(body)), None)


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def battery(run: str) -> float:
    """The p-value of a run under ordinary text; 1 if it is no encoding or a test speaks against randomness."""
    body = bare(run)
    found = encoding(body)
    if not found or len(body) < 2:
        return 1.0
    n, size = len(body), found[1]
    counts = Counter(body)
    expected = n / size
    chi = sum((v - expected) ** 2 for v in counts.values()) / expected + (size - len(counts)) * expected
    if _chi_upper(chi, size - 1) < VETO:
        return 1.0
    classes = [_class(c) for c in body]
    changes = sum(a != b for a, b in zip(classes, classes[1:], strict=False))
    share = [v / n for v in Counter(classes).values()]
    mean = (n - 1) * (1 - sum(s * s for s in share))
    if _upper((mean - changes - 0.5) / math.sqrt(max(mean * sum(s * s for s in share), 0.25))) < VETO:
        return 1.0  # fewer class runs than a random order of the same characters
    order = {c: i for i, c in enumerate(sorted(counts))}
    x = [order[c] for c in body]
    m = sum(x) / n
    around = sum((v - m) ** 2 for v in x)
    serial = sum((a - m) * (b - m) for a, b in zip(x, x[1:], strict=False)) / around if around else 1.0
    if 2 * _upper(abs(serial + 1 / n) * math.sqrt(n)) < VETO:
        return 1.0
    # Under text: letters at about twice the index of coincidence of uniform ones, and neighbours of different class seldom.
    # Signs join words as often as they please, so only neighbours that both are letters or digits say anything, and a capital
    # that begins a word in small letters counts as one of them.
    text_chi = (size - 1) + (n - 1) * 0.7
    p_chi = _upper((text_chi - chi) / math.sqrt(2 * (size - 1) + 2.8 * (n - 1)))
    plain = [_class(c) for c in CAPITAL.sub("a", body)]
    inner = [(a, b) for a, b in zip(plain, plain[1:], strict=False) if a != 3 != b]
    p_runs = _binomial_upper(sum(a != b for a, b in inner), len(inner), CLASS_CHANGE)
    joint = -2 * (math.log(max(p_chi, 1e-300)) + math.log(max(p_runs, 1e-300)))
    return math.exp(-joint / 2) * (1 + joint / 2)  # Fisher's method: chi-squared with four degrees of freedom


def _binomial_upper(k: int, n: int, p: float) -> float:
    if k <= 0:
        return 1.0
    log_term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total = term = math.exp(log_term) if log_term > -690 else 0.0
    for i in range(k, n):
        term *= (n - i) / (i + 1) * p / (1 - p)
        total += term
        if term < total * 1e-12:
            break
    return min(1.0, total)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, by start and then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _tested(run: str) -> list[tuple[int, int, float]]:
    """(start, end, p) of a run, or of the stretches of one that mixes alphabets."""
    if not (re.search(r"[+/]", run) and re.search(r"[_-]", run)):
        return [(0, len(run), battery(run))]
    spans = sorted({m.span() for form in STRETCHES for m in form.finditer(run) if len(m[0]) >= MIN_RUN})
    out: list[tuple[int, int, float]] = []
    for p, _, a, b in sorted((min(1.0, len(spans) * battery(run[a:b])), a - b, a, b) for a, b in spans):
        if not any(s < b and a < e for s, e, _ in out):
            out.append((a, b, p))
    return sorted(out) or [(0, len(run), 1.0)]


def runs(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, length cell, p cell) of the runs outside the base spans that look like encodings or not; p cell 0 is p = 1."""
    out = []
    for m in RUN.finditer(text):
        if len(m[0]) < MIN_RUN:
            continue
        for a, b, p in _tested(m[0]):
            a, b = a + m.start(), b + m.start()
            if not any(s < b and a < e for s, _, e in base):
                out.append((a, b, min((b - a) // LENGTH_STEP, LENGTH_CELLS - 1), min(P_CELLS - 1, int(-math.log10(max(p, 1e-300)) * P_STEP))))
    return out


SCAN_SCHEMA = "doc_id long, base array<struct<start:int,kind:int,end:int>>, runs array<struct<start:int,end:int,length:int,p:int>>"
_SCAN_ARROW = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(pa.struct([(k, pa.int32()) for k in ("start", "kind", "end")]))), ("runs", pa.list_(pa.struct([(k, pa.int32()) for k in ("start", "end", "length", "p")])))])


def _scan(batches):
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            t = text.as_py() or ""
            base = base_spans(t)
            rows.append({"doc_id": doc_id, "base": [dict(zip(("start", "kind", "end"), s, strict=True)) for s in base], "runs": [dict(zip(("start", "end", "length", "p"), r, strict=True)) for r in runs(t, base)]})
        yield pa.RecordBatch.from_pylist(rows, _SCAN_ARROW)


def scan(docs: DataFrame) -> DataFrame:
    """Each document's base spans and runs; texts are read whole, once."""
    return text_rows(docs).mapInArrow(Tidy(_scan), SCAN_SCHEMA)


def thresholds(found: DataFrame) -> dict[int, int]:
    """For each length cell, the least p cell that the weighted Benjamini-Hochberg procedure over all runs accepts."""
    cells = found.select(F.explode("runs").alias("r")).groupBy("r.length", "r.p").count().collect()  # at most LENGTH_CELLS x P_CELLS rows
    total = sum(c["count"] for c in cells)
    if not total:
        return {}
    weight = {c["length"]: min(4.0, (c["length"] + 1) * LENGTH_STEP / 32) for c in cells}
    mean = sum(weight[c["length"]] * c["count"] for c in cells) / total
    ranked = sorted((10 ** (-c["p"] / P_STEP) / (weight[c["length"]] / mean), c["length"], c["p"], c["count"]) for c in cells)
    seen, best = 0, -1.0
    for p, _, _, count in ranked:
        seen += count
        if p <= FALSE_DISCOVERY * seen / total:
            best = p
    out: dict[int, int] = {}
    for p, length, cell, _ in ranked:
        if p <= best:
            out[length] = min(out.get(length, P_CELLS), cell)
    return out


def _accepted(limits: dict[int, int]) -> Column:
    """The runs that pass, as an expression over the scan."""
    test = lambda r: F.coalesce(*[F.when(r["length"] == k, r["p"] >= v) for k, v in sorted(limits.items())], F.lit(False))
    return F.filter("runs", test if limits else lambda r: F.lit(False))


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans, and all spans."""
    found = materialise(scan(docs), "secret-scan")
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")
    added = F.transform(_accepted(thresholds(found)), lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["end"].alias("end")))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", added))).alias("spans"), F.size(added).cast("long").alias("n_random"),
    )


def redacted(text: str | None, limits: dict[int, int]) -> str | None:
    if not text:
        return text
    base = base_spans(text)
    spans = sorted([(s, e, k) for s, k, e in base] + [(s, e, 3) for s, e, length, p in runs(text, base) if p >= limits.get(length, P_CELLS)])
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if spans else text


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with every span replaced by its kind in angle brackets.

    The texts are read twice: for the histogram that sets the thresholds, and to replace the spans.
    """
    limits = thresholds(text_rows(docs.withColumn("doc_id", F.lit(0)), text_col=text_col).mapInArrow(Tidy(_scan), SCAN_SCHEMA))

    @F.pandas_udf("string")
    def replace(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        occupy("secrets")
        for series in texts:
            yield pd.Series([redacted(t, limits) for t in series], dtype=object)

    return docs.withColumn(text_col, replace(F.col(text_col)))
