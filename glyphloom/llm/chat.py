"""Chat formatting: logs that save a conversation again after every turn are collapsed to the last snapshot, then rendered.

A turn's hash is 128 bits of role and text; a prefix's hash sums its turns' hashes, each mixed with its place, so prefixes are
running sums. Places and sums are built from blocks of ``BLOCK`` turn numbers: each block by itself, then a window over
a conversation's blocks only, so no task ever holds a whole long conversation. A conversation whose full hash is the hash
of a proper prefix of a longer one is its snapshot; of equal conversations the smallest id stays. Anti-joins keep the rest.

Defined cases: a null role is empty, and so is a null text; a row that is repeated counts once; several rows of one turn number
stand in the order of role and text; rows without conv_id are left out, a null turn comes first; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.llm.shared import materialise

BLOCK = 64
START, END = "<|im_start|>", "<|im_end|>"


def rendered(role: Column, text: Column) -> Column:
    """One turn; markers inside a role or a text are broken so that neither can forge a turn, and a role stays on its line."""
    safe = lambda c: F.regexp_replace(c, r"<\|(im_start|im_end)\|>", "<| $1 |>")
    return F.concat(F.lit(START), safe(F.translate(role, "\r\n", "  ")), F.lit("\n"), safe(text), F.lit(END + "\n"))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role, text, and h1, h2, the hash of the prefix that ends there."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role").alias("role"), empty("text").alias("text")).distinct()
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = rows.withColumn("at", F.row_number().over(inside))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n")).withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = materialise(rows.join(blocks.select("conv_id", "block", "skip"), ["conv_id", "block"]).withColumn("place", F.col("at") + F.col("skip")).drop("at", "skip"), "turns")
    part = lambda seed: F.xxhash64(F.lit(seed), "place", "role", "text").cast("decimal(20,0)")
    hashed = placed.withColumn("p1", part(1)).withColumn("p2", part(2))
    sums = hashed.groupBy("conv_id", "block").agg(F.sum("p1").alias("s1"), F.sum("p2").alias("s2"))
    sums = sums.select("conv_id", "block", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(s) for s in ("s1", "s2")])
    upto = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    out = hashed.join(sums, ["conv_id", "block"])
    return out.select("conv_id", "block", "place", "role", "text", *[(F.col(s) + F.sum(p).over(upto)).cast("decimal(38,0)").alias(h) for p, s, h in (("p1", "s1", "h1"), ("p2", "s2", "h2"))])


def collapse(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The prefixes, and conv_id, n_turns of the maximal conversations; both written."""
    found = materialise(prefixes(turns), "prefixes")
    sizes = found.groupBy("conv_id").agg(F.max("place").alias("n_turns"))
    last = materialise(found.join(sizes, "conv_id").where("place = n_turns").select("conv_id", "n_turns", "h1", "h2"), "conversations")
    one = last.groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    whole = last.select("conv_id", F.col("n_turns").alias("whole"))
    proper = found.select("conv_id", "place", "h1", "h2").join(whole.hint("merge"), "conv_id").where("place < whole").select(F.col("place").alias("n_turns"), "h1", "h2").distinct()
    return found, materialise(one.join(proper, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns"), "maximal")


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, part, rendered: each maximal conversation's text in parts of one block of turns, to be put together by part."""
    found, kept = collapse(turns)
    rows = found.join(kept.hint("merge"), "conv_id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", rendered(F.col("role"), F.col("text")).alias("t")))), lambda x: x["t"]), "")
    parts = rows.groupBy("conv_id", "n_turns", "block").agg(F.min("place").alias("first"), text.alias("rendered"))
    return parts.select("conv_id", "n_turns", F.col("first").alias("first_turn"), "rendered", F.length("rendered").cast("long").alias("n_chars"))


def snapshots_sql() -> str:
    """The same rows in DuckDB, for conversations of at most BLOCK turns numbered from 0."""
    safe = lambda c: f"regexp_replace({c}, '<\\|(im_start|im_end)\\|>', '<| \\1 |>', 'g')"
    return f"""
with t as (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
p as (select conv_id, row_number() over w as place, string_agg(md5(role) || md5(text), '') over w as prefix, role, text from t window w as (partition by conv_id order by turn, role, text)),
n as (select conv_id, max(place) as n_turns from p group by 1),
f as (select p.conv_id, n_turns, md5(prefix) as h from p join n using (conv_id) where place = n_turns),
one as (select min(conv_id) as conv_id, n_turns, h from f group by n_turns, h),
proper as (select distinct place as n_turns, md5(prefix) as h from p join n using (conv_id) where place < n.n_turns),
kept as (select conv_id, n_turns from one anti join proper using (n_turns, h)),
r as (select conv_id, n_turns, min(place) as first_turn, string_agg('{START}' || {safe("translate(role, chr(13) || chr(10), '  ')")} || chr(10) || {safe('text')} || '{END}' || chr(10), '' order by place) as rendered from p join kept using (conv_id) group by conv_id, n_turns)
select conv_id, n_turns, first_turn, rendered, length(rendered) as n_chars from r"""
