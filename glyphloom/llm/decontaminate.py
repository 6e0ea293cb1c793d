"""Benchmark decontamination by template: re-parameterised questions share a template, not their numbers and names.

Numbers, names (capitalized words inside a sentence) and units after a number become typed placeholders, each one word;
everything else is a lower-case word without punctuation. Windows of ``WINDOW`` template words of the documents are
hash-joined with those of the benchmark. A window with several slots must also fill them alike: two slots have the same
surface in the document exactly where they have in the item, so a question with other numbers matches and a shuffled one
doesn't. The same must hold over the whole item: every surface of the item stands for the one surface of the document that most of its
windows there give it (of equal ones the smallest), no surface of the document for two of the item's, and windows that say otherwise don't count. A document holds an item if it has at least ``MIN_WINDOWS`` of
the item's windows, or all if there are fewer.

Texts are read in up to four forms, and a pair's figures are those of the first that finds it:

* ``inside``: as above, each run of digits a number;
* ``grouped``: a number is one placeholder with its group and decimal separators (not a plain space);
* ``open``: so, and every capitalized word is a name, also where a text, sentence, line or quotation begins;
* ``exact``: surface words, numbers and names kept, and the whole item as one key. This is for items with fewer than
  MIN_WINDOWS + 2 windows inside (what stands around a copy can change its first and last word there).

Only DataFrame functions are used. The item windows are broadcast if there are at most ``BROADCAST_WINDOWS``; beyond that
the same join shuffles.

Defined cases: a null or blank text has no words and no windows; an item of fewer than WINDOW words is one window of its own
length in the first three forms, and of fewer than MIN_WORDS words none; windows with fewer literal words than placeholders
are left out there. Such items are found by their exact form alone, however short: an item of one word is held by every
document with that word. An item without letters and digits is its marks between white space; equal items each give their rows. Texts
are told apart by id and text: repeated rows count once, of different texts with one id each is searched by itself and ``leaks`` gives the figures of the one that
fits best, and so it does for all rows without doc_id, under a null; ``without_leaks`` drops the texts that hold an item, with or without id. Empty tables give
no rows; other columns are ignored by ``leaks`` and kept by ``without_leaks``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.llm.shared import materialise, text_rows

WINDOW, MIN_WORDS, MIN_WINDOWS = 8, 5, 4
FORMS = ["inside", "grouped", "open"]  # the first that finds a pair gives its figures
BROADCAST_WINDOWS = 500_000  # 16 MB
BROADCAST_IDS = 1_000_000  # 8 MB

# Placeholders: letters without case that no supported text uses.
NAME, NUMBER, UNIT, POINT = "ꓠ", "ꓳ", "ꓴ", "ꓒ"
GROUP = r"[.,'’_\u00a0\u2009\u202f](?<=[0-9].)(?=[0-9])"  # the rare sign first: what stands before it is looked at only there
# Fixed list of units.
UNITS = "kg|g|mg|lb|lbs|oz|km|m|cm|mm|mi|miles|mile|ft|feet|inches|inch|l|ml|litres|liters|s|sec|seconds|min|minutes|h|hours|hour|days|day|weeks|week|years|year|mph|kmh|euros|euro|dollars|dollar|eur|usd|cents|percent"


def _words(text: Column, surfaces: bool, form: str = "inside") -> Column:
    """The words of a text with placeholders, followed by the surface in lower case if that is asked for. Both have equally many words."""
    own, kept = ("$0", f"[0-9{POINT}]*") if surfaces else ("", "")
    joined = text if form == "inside" else F.regexp_replace(text, GROUP, POINT)
    name = r"\p{Lu}(?<![\p{L}\p{M}0-9]\p{Lu})[\p{L}\p{M}]*" if form == "open" else r"\p{Lu}(?<=[\p{Ll}0-9,;] \p{Lu})\p{Ll}+"
    named = F.lower(F.regexp_replace(joined, name, NAME + own))
    counted = F.regexp_replace(named, f"[0-9]+(?:{POINT}[0-9]+)*", NUMBER + own)
    measured = F.regexp_replace(counted, rf"({NUMBER}{kept}) ?(?:({UNITS})(?![\p{{L}}\p{{M}}0-9])|%)", f"$1 {UNIT}" + ("$2" if surfaces else ""))
    return F.filter(F.split(measured, r"[^\p{L}\p{M}0-9]+"), lambda w: w != "")


def _surface(text: Column, between: str) -> Column:
    return F.filter(F.split(F.lower(text), between), lambda w: w != "")


def _is_slot(word: Column) -> Column:
    return F.substring(word, 1, 1).isin(NAME, NUMBER, UNIT)


def _parts(size: int) -> list[int]:
    """The powers of two that a window's hash is put together from, largest first."""
    return [1 << i for i in reversed(range(size.bit_length())) if size >> i & 1]


def _window_hash(window: Column) -> Column:
    """The hash of a window of at most WINDOW words: words in pairs, pairs in pairs, then the parts from left to right."""

    def part(first: int, size: int) -> Column:
        if size == 1:
            return F.xxhash64(F.get(window, F.lit(first)))
        return F.xxhash64(part(first, size // 2), part(first + size // 2, size // 2))

    def whole(size: int) -> Column:
        out, at = None, 0
        for p in _parts(size):
            out = part(at, p) if out is None else F.xxhash64(out, part(at, p))
            at += p
        return out

    return F.coalesce(*[F.when(F.size(window) == size, whole(size)) for size in range(1, WINDOW + 1)])


def _joined(left: str | Column, right: str, at: int) -> Column:
    """At every place, the hash of what ``left`` has there and ``right`` has ``at`` places on."""
    return F.zip_with(left, F.slice(right, at + 1, F.greatest(F.size(right) - at, F.lit(0))), lambda x, y: F.xxhash64(x, y))


def _windows(rows: DataFrame, words: Column, sizes: list[int]) -> DataFrame:
    """rows (row, doc_id, text) to (row, doc_id, size, pos, hash): every window of each size, from word 1 on."""
    hashed = rows.select("row", "doc_id", F.transform(words, lambda w: F.xxhash64(w)).alias("of1"))
    p = 1
    while 2 * p <= max(sizes):
        hashed = hashed.withColumn(f"of{2 * p}", _joined(f"of{p}", f"of{p}", p))
        p *= 2
    out = None
    for size in sizes:
        first, *others = _parts(size)
        each, at = F.col(f"of{first}"), first
        for p in others:
            each, at = _joined(each, f"of{p}", at), at + p
        each = F.slice(each, F.lit(1), F.greatest(F.size("of1") - (size - 1), F.lit(0)))
        one = hashed.select("row", "doc_id", F.lit(size).alias("size"), F.posexplode(each).alias("pos", "hash")).withColumn("pos", F.col("pos") + 1)
        out = one if out is None else out.union(one)
    return out


def _pattern(slots: Column) -> Column:
    return F.transform(slots, lambda s: F.array_position(slots, s))


def _slots(words: str, pos: Column, size: Column) -> Column:
    return F.filter(F.slice(F.col(words), pos, size), _is_slot)


def _hash_of(words: Column) -> Column:
    return F.xxhash64(F.transform(words, lambda w: F.xxhash64(w)))


def _sizes(side: DataFrame) -> list[int]:
    return sorted(r["size"] for r in side.select("size").distinct().collect())  # at most WINDOW values


def _small(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


def benchmark_windows(rows: DataFrame) -> DataFrame:
    """form, item_id, copy, size, ipos, hash, slots with their surfaces, and the item's number of windows in that form; written, as it is used often."""
    worded = [rows.select(F.lit(form).alias("form"), "item_id", "copy", _words(F.col("text"), False, form).alias("plain"), _words(F.col("text"), True, form).alias("full")) for form in FORMS]
    words = materialise(reduce(DataFrame.union, worded), "items")
    size = F.least(F.size("plain"), F.lit(WINDOW))
    each = words.where(F.size("plain") >= MIN_WORDS).withColumn("size", size).withColumn("ipos", F.explode(F.sequence(F.lit(1), F.size("plain") - F.col("size") + 1)))
    window = F.slice("plain", F.col("ipos"), F.col("size"))
    literal = F.size(F.filter(window, lambda w: ~_is_slot(w)))
    found = each.where(2 * literal >= F.col("size")).withColumn("window", window)
    found = found.select("form", "item_id", "copy", "size", "ipos", _window_hash(F.col("window")).alias("hash"), _slots("full", F.col("ipos"), F.col("size")).alias("slots"))
    total = found.groupBy("form", "item_id", "copy").agg(F.count("*").alias("item_windows"))
    return materialise(found.join(total, ["form", "item_id", "copy"]), "item-windows")


def _held(texts: dict[str, DataFrame], wanted: DataFrame) -> DataFrame:
    """A line for each form, text and item it holds; ``texts`` has the rows to search in each form. All forms share their jobs."""
    sizes = _sizes(wanted) or [WINDOW]
    side = _small(wanted.select("form", "size", "hash", "item_id", "copy", "ipos", "item_windows", "slots"), BROADCAST_WINDOWS)
    windows = [_windows(rows, _words(F.col("text"), False, form), sizes).withColumn("form", F.lit(form)) for form, rows in texts.items()]
    found = materialise(reduce(DataFrame.union, windows).join(side, ["form", "size", "hash"]), "matches")
    # Only an item with enough windows in a text can be held there, whatever its slots say; the tests below can only take windows away.
    pair, place = ["form", "row", "item_id", "copy"], ["form", "row", "item_id", "copy", "ipos", "pos"]
    enough = found.select(*pair, "item_windows", "ipos").distinct().groupBy(*pair, "item_windows").count().where(F.col("count") >= F.least("item_windows", F.lit(MIN_WINDOWS)))
    found = materialise(found.join(enough.select(*pair), pair, "left_semi"), "enough")
    # Windows with slots are held against the text's surfaces.
    slotted = F.size("slots") > 0
    to_test = _small(materialise(found.where(slotted).select("form", "row").distinct(), "slotted"), BROADCAST_IDS)
    read_again = [rows.withColumn("form", F.lit(form)).join(to_test, ["form", "row"], "left_semi").select("form", "row", _words(F.col("text"), True, form).alias("full")) for form, rows in texts.items()]
    filled = found.where(slotted).join(reduce(DataFrame.union, read_again), ["form", "row"]).withColumn("own", _slots("full", F.col("pos"), F.col("size"))).drop("full")
    tested = materialise(filled.where(_pattern(F.col("own")) == _pattern(F.col("slots"))), "filled-alike")
    said = materialise(tested.select(*place, F.explode(F.arrays_zip("slots", "own")).alias("z")).select(*place, F.col("z.slots").alias("s"), F.col("z.own").alias("o")).distinct(), "said")
    votes = said.select(*pair, "ipos", "s", "o").distinct().groupBy(*pair, "s", "o").agg((-F.count("*")).alias("n"))
    first = votes.groupBy(*pair, "s").agg(F.min(F.struct("n", "o")).alias("b")).select(*pair, "s", "b.*")
    agreed = first.groupBy(*pair, "o").agg(F.min(F.struct("n", "s")).alias("b")).select(*pair, F.col("b.s").alias("s"), "o")
    against = said.join(agreed, [*pair, "s", "o"], "left_anti").select(*place).distinct()
    columns = ["doc_id", *place, "item_windows"]
    alike = found.where(~slotted).select(columns).union(tested.join(against, place, "left_anti").select(columns))
    per_window = alike.groupBy("doc_id", *pair, "item_windows", "ipos").agg(F.min("pos").alias("pos"))
    held = per_window.groupBy("doc_id", *pair, "item_windows").agg(F.count("*").alias("n_windows"), F.min("pos").cast("long").alias("first_word"))
    return held.where(F.col("n_windows") >= F.least("item_windows", F.lit(MIN_WINDOWS)))


def _held_exactly(rows: DataFrame, items: DataFrame, between: str) -> DataFrame | None:
    """The same for whole items (item_id, copy, text): their first words are joined, and the rest of longer ones compared."""
    words = items.select("item_id", "copy", _surface(F.col("text"), between).alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(WINDOW))
    keyed = words.select("item_id", "copy", F.size("words").alias("length"), size.alias("size"), _window_hash(F.slice("words", F.lit(1), size)).alias("hash"), _hash_of(F.col("words")).alias("whole"))
    keyed = materialise(keyed, "exact-items")
    sizes = _sizes(keyed)
    if not sizes:
        return None
    found = materialise(_windows(rows, _surface(F.col("text"), between), sizes).join(_small(keyed, BROADCAST_WINDOWS), ["size", "hash"]), "exact-matches")
    longer = F.col("length") > F.col("size")
    to_test = _small(materialise(found.where(longer).select("row").distinct(), "exact-longer"), BROADCAST_IDS)
    texts = rows.join(to_test, "row", "left_semi").select("row", _surface(F.col("text"), between).alias("words"))
    tested = found.where(longer).join(texts, "row").where(_hash_of(F.slice("words", F.col("pos"), F.col("length"))) == F.col("whole"))
    columns = ["row", "doc_id", "item_id", "copy", "pos"]
    held = found.where(~longer).select(columns).union(tested.select(columns)).groupBy("row", "doc_id", "item_id", "copy").agg(F.min("pos").cast("long").alias("first_word"))
    return held.withColumn("n_windows", F.lit(1).cast("long")).withColumn("item_windows", F.lit(1).cast("long"))


def _row() -> Column:
    """What tells texts apart: id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))


def _found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """row, doc_id, item_id, copy and the best figures of each text and item it holds."""
    rows = text_rows(docs).withColumn("row", _row())
    own = materialise(text_rows(items, "item_id").select(F.col("doc_id").alias("item_id"), F.monotonically_increasing_id().alias("copy"), "text"), "benchmark")
    windows = benchmark_windows(own)
    # Without such numbers on either side the second form is the first one.
    grouped = rows if not own.where(F.col("text").rlike(GROUP)).isEmpty() else rows.where(F.col("text").rlike(GROUP))
    templates = _held({"inside": rows, "grouped": grouped, "open": rows}, windows)
    safe = windows.where((F.col("form") == "inside") & (F.col("item_windows") >= MIN_WINDOWS + 2)).select("item_id", "copy").distinct()
    rest = materialise(own.join(safe, ["item_id", "copy"], "left_anti"), "few-windows")
    worded = F.col("text").rlike(r"[\p{L}\p{M}\p{N}]")
    whole = [_held_exactly(rows, rest.where(worded), r"[^\p{L}\p{M}\p{N}]+"), _held_exactly(rows, rest.where(~worded), r"\s+")]
    parts = [templates, *(p.withColumn("form", F.lit("exact")) for p in whole if p is not None)]
    rank = F.array_position(F.array(*map(F.lit, FORMS), F.lit("exact")), F.col("form"))
    figures = ["n_windows", "item_windows", "first_word"]
    best = F.struct(rank.alias("rank"), (-F.col("n_windows")).alias("most"), *figures).alias("best")
    return reduce(DataFrame.union, [p.select("row", "doc_id", "item_id", "copy", best) for p in parts])


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each document and item it holds: doc_id, item_id, n_windows, item_windows, coverage, first_word."""
    held = _found(docs, items).groupBy("doc_id", "item_id", "copy").agg(F.min("best").alias("best")).select("doc_id", "item_id", "best.*")
    return held.select("doc_id", "item_id", "n_windows", "item_windows", (F.col("n_windows") / F.col("item_windows")).alias("coverage"), "first_word")


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    held = materialise(_found(docs, items).select(F.col("row").alias("_held_row")).distinct(), "held")
    held = F.broadcast(held) if held.count() <= BROADCAST_IDS else held.hint("merge")
    return docs.join(held, _row() == F.col("_held_row"), "left_anti")


_SQL_WORDS = """string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(
  regexp_replace(regexp_replace(coalesce(text, ''), '([\\p{Ll}0-9,;] )(\\p{Lu}\\p{Ll}+)', '\\1<N><own2>', 'g'), '([\\p{Ll}0-9,;<N>] )(\\p{Lu}\\p{Ll}+)', '\\1<N><own2>', 'g')),
  '([0-9]+)', '<O><own1>', 'g'), '(<O><kept>) ?((<units>)([^\\p{L}\\p{M}0-9]|$)|%)', '\\1 <U><own3> \\4', 'g'), '[^\\p{L}\\p{M}0-9]+', ' ', 'g')), ' ')"""


def _sql_words(surfaces: bool) -> str:
    own = {f"<own{i}>": f"\\{i}" if surfaces else "" for i in (1, 2, 3)}
    for k, v in {**own, "<kept>": "[0-9]*" if surfaces else "", "<units>": "|".join(sorted(UNITS.split("|"), key=len, reverse=True)), "<N>": NAME, "<O>": NUMBER, "<U>": UNIT}.items():
        words = _SQL_WORDS.replace(k, v) if k == "<own1>" else words.replace(k, v)
    return words


def leaks_sql() -> str:
    """The same rows in DuckDB, for a benchmark whose items all have WINDOW words or more."""
    slot = f"x[1] in ('{NAME}', '{NUMBER}', '{UNIT}')"
    slots = f"list_filter(list_slice(full_words, pos, pos + {WINDOW - 1}), lambda x: {slot})"
    alike = lambda x: f"list_transform({x}, lambda x: list_position({x}, x))"
    return f"""
with d as (select row_number() over () as r, doc_id, {_sql_words(False)} as words, {_sql_words(True)} as full_words from documents),
b as (select item_id, {_sql_words(False)} as words, {_sql_words(True)} as full_words from benchmark),
dw as (select r, pos, array_to_string(list_slice(words, pos, pos + {WINDOW - 1}), ' ') as w from (select *, unnest(range(1, len(words) - {WINDOW - 2})) as pos from d)),
bp as (select *, unnest(range(1, len(words) - {WINDOW - 2})) as pos from b),
bs as (select item_id, pos, array_to_string(list_slice(words, pos, pos + {WINDOW - 1}), ' ') as w, {slots} as slots from bp
  where 2 * len(list_filter(list_slice(words, pos, pos + {WINDOW - 1}), lambda x: not ({slot}))) >= {WINDOW}),
bw as (select item_id, pos as ipos, w, slots, count(*) over (partition by item_id) as item_windows from bs),
m as (select dw.r, dw.pos, bw.* from dw join bw using (w)),
mp as (select m.*, doc_id, {slots} as own from m join d using (r)),
tw as (select * from mp where {alike('own')} = {alike('slots')}),
said as (select r, item_id, ipos, pos, unnest(slots) as s, unnest(own) as o from tw),
votes as (select r, item_id, s, o, count(distinct ipos) as n from said group by all),
one as (select * from votes qualify row_number() over (partition by r, item_id, s order by n desc, o) = 1),
agreed as (select * from one qualify row_number() over (partition by r, item_id, o order by n desc, s) = 1),
against as (select distinct r, item_id, ipos, pos from said anti join agreed using (r, item_id, s, o)),
ok as (select r, doc_id, item_id, item_windows, ipos, min(pos) as pos from tw anti join against using (r, item_id, ipos, pos) group by all),
held as (select r, doc_id, item_id, item_windows, count(*) as n_windows, min(pos) as first_word from ok group by all having count(*) >= least(item_windows, {MIN_WINDOWS}))
select doc_id, item_id, n_windows, item_windows, n_windows / item_windows as coverage, first_word
from held qualify row_number() over (partition by doc_id, item_id order by n_windows desc, first_word) = 1"""
