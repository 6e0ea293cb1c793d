import random

import pytest
from pyspark.sql import functions as F

from glyphloom.functions import tokens as T
from glyphloom.operators import clustering, profile, scoring
from glyphloom.plans import pattern as P
from glyphloom.sources import columns


def regexes(spark, values, **options):
    return profile.profile_list(spark, values, **options).regexes()


def codes(prefixes, n, width):
    return [f"{p}-{i:0{width}d}" for p in prefixes for i in range(1, n + 1)]


def test_tokens(spark):
    values = ["", "AB-12", "ABCdef  x\t9é日.", "a_b", "É", "\r\n x"]
    rows = columns.from_list(spark, values).select("value", T.tokenize(F.col("value")).alias("t"), T.skeleton(F.col("value")).alias("s"), T.signature(F.col("value")).alias("g"), T.compact_signature(F.col("value")).alias("c")).collect()
    got = {r["value"]: r for r in rows}
    for v in values:
        assert "".join(t["value"] for t in got[v]["t"]) == v
        assert "".join({"delimiter": t["value"], "whitespace": "_"}.get(t["type"], "X") for t in got[v]["t"]) == got[v]["s"]
    assert [(t["type"], t["value"], t["length"], t["position"]) for t in got["AB-12"]["t"]] == [("upper", "AB", 2, 0), ("delimiter", "-", 1, 2), ("digits", "12", 2, 3)]
    assert got["AB-12"]["g"] == "UU-DD" and got["AB-12"]["c"] == "U-D" and got["ABCdef  x\t9é日."]["s"] == "XX_X_XX."
    merged = columns.from_list(spark, ["Abc9x"]).select(T.tokenize(F.col("value"), merge_alpha=True).alias("t")).first()["t"]
    assert [(t["type"], t["value"]) for t in merged] == [("alpha", "Abc"), ("digits", "9"), ("lower", "x")]


@pytest.mark.parametrize(
    ("values", "want"),
    [
        (["active", "pending", "completed", "cancelled"] * 250, ["(active|cancelled|completed|pending)"]),
        (["constant"] * 10, ["constant"]),
        (codes(["ACC", "ORG"], 10, 3), [r"(ACC|ORG)\-\d{3}"]),
        (codes(["ACC", "ORG", "ACCT", "ACME"], 20, 5), [r"(ACC|ACCT|ACME|ORG)\-\d{5}"]),
        ([f"{y}-Q{q}" for y in range(2020, 2026) for q in range(1, 5)], [r"\d{4}\-Q(1|2|3|4)"]),
        ([f"ID-{i:03d}" for i in range(1, 100)] + ["TOTALLY_DIFFERENT"], [r"ID\-\d{3}", "TOTALLY_DIFFERENT"]),
        ([f"CODE-{i:03d}" for i in range(20)] + [f"user{i}@test.com" for i in range(20)] + ["active", "completed", "pending"], [r"CODE\-\d{3}", r"user\d{1,2}@test\.com", "(active|completed|pending)"]),
    ],
)
def test_golden(spark, values, want):
    assert regexes(spark, values) == want


def test_anomalies_and_export(spark):
    p = profile.profile_list(spark, [f"A-{i}" for i in range(1, 101)] + ["ANOMALY"])
    assert p.regexes() == [r"A\-\d{1,3}"] and [r["value"] for r in p.anomalies().collect()] == ["ANOMALY"]
    assert p.validate("A-999") and not p.validate("B-1") and p.stats.anomaly_count == 1
    assert set(p.export()["patterns"][0]) == {"regex", "pretty", "coverage", "matched_count", "specificity"}
    assert "  1. A\\-\\d{1,3} (99.0% coverage)" in p.summary() and '    - "ANOMALY"' in p.summary()
    several = profile.profile_list(spark, [f"ACC-{i:03d}" for i in range(1, 101)] + ["WEIRD1", "weird2", "12345", "!@#$"])
    assert several.regexes() == [r"ACC\-\d{3}", "(12345|WEIRD|weird)(1|2)"]
    assert sorted(r["value"] for r in several.anomalies().collect()) == ["!@#$", "12345"]


def test_errors_and_nulls(spark):
    with pytest.raises(columns.EmptyInputError, match="empty_input"):
        profile.profile_list(spark, [])
    with pytest.raises(columns.NonStringValuesError):
        profile.profile_list(spark, [1, 2])
    with pytest.raises(columns.NotAColumnError):
        profile.profile_list(spark, "text")
    with_null = spark.createDataFrame([("a",), (None,)], "value string")
    with pytest.raises(columns.NonStringValuesError):
        profile.profile(with_null)
    assert profile.profile(with_null, nulls="ignore").regexes() == ["a"]


def test_empty_strings_and_bytes(spark):
    p = profile.profile_list(spark, [""] * 5 + [f"A-{i}" for i in range(20)])
    assert "()()" in p.regexes()
    assert columns.from_list(spark, ["é", "ab", "a\n", "a\r\n"]).where(P.matches(F.col("value"), P.any_(1, 1))).collect() == [("a\n",)]


def test_limits_merge_and_infer(spark):
    many = ["X" * (i % 10 + 1) + "-" * (i % 7 + 1) + str(i) for i in range(100)]
    assert len(profile.profile_list(spark, many, max_clusters=3).patterns) <= 3
    assert len(profile.profile_list(spark, many, max_clusters=1).patterns) <= 1
    merged = profile.merge(profile.profile_list(spark, [f"A-{i}" for i in range(1, 51)]), profile.profile_list(spark, [f"A-{i}" for i in range(51, 101)]))
    assert merged.stats.total_values == 100
    assert profile.infer_regex(columns.from_list(spark, ["A-1", "B-2", "C-3"])) == r"(A|B|C)\-(1|2|3)"
    assert regexes(spark, ["A-1", "B-2", "C-3"]) == [r"(A\-1|B\-2|C\-3)"]


def naive_merge(groups, threshold=0.3):
    def levenshtein(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    import re

    norm = [re.sub("X+", "X", s) for s in groups]
    left, out = list(range(len(groups))), []
    while left:
        lead = left[0]
        near = [i for i in left if i == lead or norm[i] == norm[lead] or levenshtein(norm[i], norm[lead]) / max(len(norm[i]), len(norm[lead])) <= threshold]
        out.append(near)
        left = [i for i in left if i not in near]
    return out


def merged(spark, values):
    """The clusters in order as sets of skeletons, by the operator and by the naive merge of ranked groups."""
    groups = clustering.initial_groups(columns.value_counts(columns.from_list(spark, values)))
    ranked = [r["skeleton"] for r in groups.orderBy(F.desc("size"), "skeleton").collect()]
    assigned, sizes = clustering.merge_groups(clustering.merged_groups(groups))
    rows = groups.withColumn("norm", T.normalized_skeleton(F.col("skeleton"))).join(assigned, "norm").collect()
    got = [{r["skeleton"] for r in rows if r["cluster"] == c} for c in range(len(sizes))]
    assert sizes == [sum(r["size"] for r in rows if r["cluster"] == c) for c in range(len(sizes))]
    return got, [{ranked[i] for i in c} for c in naive_merge(ranked)]


def test_merge_equals_naive(spark):
    random.seed(4)
    got, want = merged(spark, ["".join(random.choice("a1-.@ _") for _ in range(random.randint(1, 9))) for _ in range(300)])
    assert got == want


def test_free_text_merge_equals_naive(spark):
    random.seed(5)
    texts = [" ".join(random.choice(["word", "and,", "Two.", "x-y", "12"]) for _ in range(random.randint(1, 60))) for _ in range(80)]
    got, want = merged(spark, texts)
    assert got == want and len(got) < 30


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_bit_vectors_equal_naive(spark, monkeypatch):
    import numpy as np

    from glyphloom.functions import distance

    random.seed(6)
    text = lambda n: "".join(random.choice("X_,.") for _ in range(n))
    for size in (1, 63, 64, 65, 129, 200):
        lead = text(size)
        others = sorted([text(int(size * random.uniform(0.6, 1.5)) + 1) for _ in range(8)] + [lead[k:] + "X" * k for k in range(0, size, 20)], key=len)
        want = [edit_distance(lead, t) for t in others]
        assert distance._batch(distance.Leader(lead), [distance.codes(t) for t in others], 1000).tolist() == want
        for threshold in (0.1, 0.3, 0.5):
            got = distance.first_near([distance.Leader(lead)], ["", *others], threshold)
            assert got.tolist() == [-1] + [0 if w / max(size, len(t)) <= threshold else -1 for w, t in zip(want, others, strict=True)]
    assert distance.first_near([distance.Leader("")], ["", "X"], 0.3).tolist() == [0, -1] and distance.first_near([], ["X"], 0.3).dtype == np.int32
    # Skeletons longer than SHORT: the built-in edit distance isn't asked, which took 5 ms and more a pair of long texts.
    monkeypatch.setattr(clustering, "_near", None)
    got, want = merged(spark, [" ".join(random.choice(["word", "and,", "Two.", "x-y", "12"]) for _ in range(random.randint(1, 160))) for _ in range(40)])
    assert got == want


def test_free_text_positions_are_not_all_collected(spark, monkeypatch):
    from glyphloom.operators import synthesis

    random.seed(7)
    texts = [" ".join("".join(random.choice("abcdefghij") for _ in range(random.randint(1, 9))) + random.choice(["", "", ",", "."]) for _ in range(random.randint(45, 110))) for _ in range(600)]
    rows = [f"{i:03d}-" * 40 + "end" for i in range(600)]  # 81 tokens, and a pattern of as many positions
    asked, collect = [], synthesis.collect_positions
    monkeypatch.setattr(synthesis, "collect_positions", lambda *a, **k: asked.append((a, k)) or collect(*a, **k))
    assert regexes(spark, texts, min_coverage=0.4) == [] and [k for _, k in asked] == [{"upto": synthesis.PREFIX}]
    assert regexes(spark, rows) == [r"\d{3}\-" * 40 + "end"] and len(asked) == 3
    both = profile.profile_list(spark, texts + rows, min_coverage=0.4)
    everything = profile.profile_list(spark, texts + rows, min_coverage=0.0)
    assert both.regexes() == [p.regex for p in everything.patterns if p.coverage >= 0.4] and len(everything.patterns) > len(both.patterns)


def test_long_values_are_not_quadratic(spark):
    import time

    value = "ab 1" * 6_667  # 20,001 tokens
    began = time.time()
    (row,) = columns.from_list(spark, [value]).select(T.tokenize(F.col("value")).alias("t")).select(F.size("t").alias("n"), F.col("t")[20_000]["position"].alias("last"), F.col("t")[10_000]["position"].alias("middle")).collect()
    lengths = [2, 1, 1] * 6_667
    assert (row.n, row.last, row.middle) == (20_001, sum(lengths[:20_000]), sum(lengths[:10_000]))
    assert time.time() - began < 15  # seconds of a slow machine; appending one by one took 47 of a fast one


def test_token_totals_without_tokens(spark):
    values = ["AB-12 x\u00e9", "e\u0301a", "\u0301\u0301 a", "a\r\nb\r\n\r\n", "\u0600a b", "x\u200d\U0001f469", "\U0001f469\u200d\U0001f469 1\U0001f44d\U0001f3fd", "\0\x01\u00e9\u0300\n", "\u1100\u1161x\u1161", "\u00e9\r", "1\ufe0f\u20e3", "", "\x7f\u0301"]
    t = T.token_values(F.col("value"))
    row = columns.from_list(spark, values).select("value", F.size(t).alias("n"), F.aggregate(t, F.lit(0), lambda a, x: a + F.regexp_count(x, F.lit(r"\X"))).alias("length"), T.token_count(F.col("value")).alias("count"), T.tokens_length(F.col("value")).alias("total"), T.tokenize(F.col("value")).alias("t"))
    for r in row.collect():
        assert (r["count"], r["total"]) == (r["n"], r["length"]), r["value"]
        assert sum(t["length"] for t in r["t"]) == r["length"]
    kinds = columns.from_list(spark, ["aB1 \t-_~!\u00e9\0" + chr(127)]).select(F.explode(t).alias("t")).select(T.run_type(F.col("t")).alias("one"), T.token_type(F.col("t")).alias("two")).collect()
    assert len(kinds) == 9 and all(r["one"] == r["two"] for r in kinds)


def test_token_signs(spark):
    row = columns.from_list(spark, ["AB-12 xé"]).select(F.transform(T.tokenize(F.col("value")), lambda t: F.struct(T.signature_char(t).alias("c"), T.token_signature(t).alias("s"))).alias("t")).first()["t"]
    assert [(r["c"], r["s"]) for r in row] == [("U", "UU"), ("-", "-"), ("D", "DD"), ("_", "_"), ("L", "L"), ("é", "é")]
    pairs = [("upper", "lower", True), ("digits", "digits", True), ("digits", "upper", False), ("alpha", "upper", True), ("delimiter", "whitespace", False)]
    rows = spark.createDataFrame(pairs, "a string, b string, want boolean").select("want", T.compatible(F.col("a"), F.col("b")).alias("got")).collect()
    assert all(r.want == r.got for r in rows)


def test_options(spark):
    values = [f"A-{i}" for i in range(97)] + ["~odd~", "@@@", "!x!"]
    assert len(profile.profile_list(spark, values, min_coverage=0.0).patterns) > len(profile.profile_list(spark, values, min_coverage=0.5).patterns) == 1
    off = profile.profile_list(spark, values, min_coverage=0.5, detect_anomalies=False)
    assert off.stats.anomaly_count == 0 and off.anomalies().count() == 0
    counts = columns.value_counts(columns.from_list(spark, values))
    assert [s for s in clustering.cluster(counts, min_cluster_size=5).sizes.values()] == [97]


def test_groups_and_batches(spark, tmp_path):
    from glyphloom.streaming.validation import profile_batches

    rows = spark.createDataFrame([("a", f"A-{i}") for i in range(20)] + [("b", f"{i}x") for i in range(20)], "g string, value string")
    found = profile.profile_groups(rows, "value", "g")
    assert {k: p.regexes() for k, p in found.items()} == {"a": profile.profile(rows.where("g = 'a'")).regexes(), "b": profile.profile(rows.where("g = 'b'")).regexes()}
    for k in range(3):
        spark.createDataFrame([(f"B-{100 * k + i}",) for i in range(15)], "value string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = profile_batches(stream, "value", lambda p, epoch: seen.append((p.stats.total_values, p.regexes()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [n for n, _ in seen] == [15, 30, 45] and len(seen[-1][1]) == 1


def test_scoring(spark):
    counts = columns.value_counts(columns.from_list(spark, ["A1", "B2", "cc", "A1"]))
    p = P.seq([P.char_class("upper"), P.char_class("digit")])
    assert scoring.coverage(counts, p) == 0.75 and scoring.report(counts, p)["stats"]["unmatched_sample"] == ["cc"]
    assert scoring.compare(counts, p, p)[0] == "tie" and scoring.rank(counts, [P.any_(), p])[0][0] == p
    invalid = columns.value_counts(columns.from_list(spark, ["Z9"]))
    assert scoring.precision(counts, p, invalid) == pytest.approx((p.specificity() + 0.75) / 2)
    assert scoring.suggest_enum_threshold(columns.from_list(spark, ["a", "b"] * 3)).first()["threshold"] == 7


def test_stream(spark, tmp_path):
    from glyphloom.streaming.validation import reject_stream

    p = profile.profile_list(spark, [f"A-{i}" for i in range(30)])
    spark.createDataFrame([("A-7",), ("nope",)], "value string").write.parquet(str(tmp_path / "in"))
    q = reject_stream(spark.readStream.schema("value string").parquet(str(tmp_path / "in")), "value", p).writeStream.format("memory").queryName("rejected").start()
    q.processAllAvailable()
    q.stop()
    assert [r["value"] for r in spark.sql("select value from rejected").collect()] == ["nope"]
