"""Token operators as Column expressions. All stay in the JVM; none needs a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character classes of the tokenizer (delimiters are the 32 ASCII punctuation characters).
DELIMITERS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
WHITESPACE = " \t\n\r"
DELIMITER_CLASS = r"!-/:-@\[-`{-~"
SPACE_CLASS = r" \t\n\r"
TYPES = ("digits", "upper", "lower", "alpha", "alnum", "whitespace", "delimiter", "literal")
SIGNATURE = {"digits": "D", "upper": "U", "lower": "L", "alpha": "A", "alnum": "X", "whitespace": "_"}

_REST = rf"[{SPACE_CLASS}]+|[{DELIMITER_CLASS}]|[^0-9A-Za-z{SPACE_CLASS}{DELIMITER_CLASS}]+"
TOKEN = rf"[0-9]+|[A-Z]+|[a-z]+|{_REST}"
MERGED_TOKEN = rf"[0-9]+|[A-Za-z]+|{_REST}"


def graphemes(value: Column) -> Column:
    """Length in grapheme clusters. In ASCII that is the number of characters, but for CR LF pairs."""
    plain = (F.octet_length(value) == F.length(value)) & ~F.contains(value, F.lit("\r"))
    return F.when(plain, F.length(value)).otherwise(F.regexp_count(value, F.lit(r"\X")))


def token_type(value: Column) -> Column:
    """The type of a token's text, from its characters; a run that mixes cases is ``alpha``."""
    first = F.substring(value, 1, 1)
    return (
        F.when(first.rlike("^[0-9]"), "digits").when(value.rlike("^[A-Z]+$"), "upper").when(value.rlike("^[a-z]+$"), "lower").when(first.rlike("^[A-Za-z]"), "alpha")
        .when(first.rlike(rf"^[{SPACE_CLASS}]"), "whitespace").when(first.rlike(rf"^[{DELIMITER_CLASS}]"), "delimiter").otherwise("literal")
    )


def run_type(value: Column) -> Column:
    """``token_type`` of what ``token_values`` gives without merging: runs of one class, which the first character tells."""
    first = F.substring(value, 1, 1)
    return (
        F.when(first.between("a", "z"), "lower").when(first.isin(*WHITESPACE), "whitespace").when(first.between("0", "9"), "digits").when(first.between("A", "Z"), "upper")
        .when(first.between("!", "~"), "delimiter").otherwise("literal")
    )


def token(kind: Column | str, value: Column, position: Column | int = 0) -> Column:
    """One token as a struct of type, value, length (graphemes) and position."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(kind).alias("type"), value.alias("value"), graphemes(value).alias("length"), as_column(position).cast("int").alias("position"))


def token_values(value: Column, merge_alpha: bool = False) -> Column:
    return F.regexp_extract_all(value, F.lit(MERGED_TOKEN if merge_alpha else TOKEN), F.lit(0))


def token_count(value: Column, merge_alpha: bool = False) -> Column:
    """How many tokens a string has: each is replaced by one sign, which makes no array of them."""
    return F.length(F.regexp_replace(value, MERGED_TOKEN if merge_alpha else TOKEN, "X"))


def tokens_length(value: Column) -> Column:
    """The sum of the tokens' lengths in graphemes, without the tokens. They differ from characters in CR LF pairs and in literals only.

    Literals are counted together, parted by line feeds, which are graphemes of their own beside anything.
    """
    parted = F.trim(F.regexp_replace(value, rf"[0-9A-Za-z{SPACE_CLASS}{DELIMITER_CLASS}]+", "\n"), F.lit("\n"))
    bare = F.replace(parted, F.lit("\n"), F.lit(""))
    pairs = F.when(F.contains(value, F.lit("\r\n")), F.length(value) - F.length(F.replace(value, F.lit("\r\n"), F.lit("\n")))).otherwise(0)
    joined = F.length(bare) - (F.regexp_count(parted, F.lit(r"\X")) - (F.length(parted) - F.length(bare)))
    # Below U+0300 no character but CR LF joins another, so that only others need counting.
    return F.length(value) - pairs - F.when(bare.rlike(r"[^\x{0}-\x{2FF}]"), joined).otherwise(0)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once; a lambda would compute an outer expression anew for each element."""
    return F.transform(F.array(value), use)[0]


def tokenize(value: Column, merge_alpha: bool = False, preserve_case: bool = True) -> Column:
    """A string's tokens. ``preserve_case`` is accepted and changes nothing.

    Positions are running sums of lengths, taken in blocks of about the square root of the number of tokens: the sum of the blocks
    before, and of the tokens before in the block.
    """
    bare = F.transform(token_values(value, merge_alpha), lambda t: F.struct((token_type(t) if merge_alpha else run_type(t)).alias("type"), t.alias("value"), graphemes(t).alias("length")))
    total = lambda part: F.aggregate(part, F.lit(0), lambda n, t: n + t["length"])
    sized = _let(bare, lambda x: F.struct(x.alias("all"), F.greatest(F.lit(32), F.sqrt(F.size(x)).cast("int")).alias("each")))
    blocks = _let(sized, lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(s["all"]), F.lit(1)) - 1) / s["each"]).cast("int")), lambda k: F.slice(s["all"], k * s["each"] + 1, s["each"])))
    summed = _let(blocks, lambda b: F.struct(b.alias("blocks"), F.transform(b, total).alias("totals")))
    placed = lambda part, base: F.transform(part, lambda t, j: F.struct(t["type"].alias("type"), t["value"].alias("value"), t["length"].alias("length"), (base + total(F.slice(part, F.lit(1), j))).alias("position")))
    before = lambda totals, k: F.aggregate(F.slice(totals, F.lit(1), k), F.lit(0), lambda n, x: n + x)
    return _let(summed, lambda s: F.flatten(F.transform(s["blocks"], lambda part, k: _let(F.struct(part.alias("part"), before(s["totals"], k).alias("base")), lambda w: placed(w["part"], w["base"])))))


def tokenize_with_positions(value: Column) -> Column:
    """Each token with its start and end (exclusive)."""
    return F.transform(tokenize(value), lambda t: F.struct(t.alias("token"), t["position"].alias("start"), (t["position"] + t["length"]).alias("end")))


def signature_char(tok: Column) -> Column:
    chain = F.lit(None)
    for kind, letter in SIGNATURE.items():
        chain = F.when(tok["type"] == kind, letter) if kind == "digits" else chain.when(tok["type"] == kind, letter)
    return chain.otherwise(tok["value"])


def token_signature(tok: Column) -> Column:
    """The type's letter, repeated to the token's length; delimiters and literals stand for themselves."""
    own = tok["type"].isin("delimiter", "literal")
    return F.when(own | (tok["length"] <= 1), signature_char(tok)).otherwise(F.repeat(signature_char(tok), tok["length"]))


def signature(value: Column) -> Column:
    """``ABC-123`` to ``UUU-DDD``. A CR LF pair is one grapheme, hence one sign."""
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    return F.translate(F.regexp_replace(value, "\r\n", "\n"), upper + lower + digits + WHITESPACE, "U" * 26 + "L" * 26 + "D" * 10 + "____")


def compact_signature(value: Column) -> Column:
    """``ABC-123`` to ``U-D``. Upper case goes first, so that no inserted letter is read again."""
    out = value
    for chars, letter in (("[A-Z]+", "U"), ("[0-9]+", "D"), ("[a-z]+", "L"), (rf"[{SPACE_CLASS}]+", "_")):
        out = F.regexp_replace(out, chars, letter)
    return out


def skeleton(value: Column) -> Column:
    """Delimiters as they are, ``_`` for white space, ``X`` for every other token."""
    text = rf"[0-9]+|[A-Z]+|[a-z]+|[^0-9A-Za-z{SPACE_CLASS}{DELIMITER_CLASS}]+"
    return F.regexp_replace(F.regexp_replace(value, text, "X"), rf"[{SPACE_CLASS}]+", "_")


def normalized_skeleton(skel: Column) -> Column:
    return F.regexp_replace(skel, "X+", "X")


def skeleton_distance(one: Column, two: Column) -> Column:
    """Edit distance of the normalized skeletons over the longer one's length; 0 if they are equal."""
    a, b = normalized_skeleton(one), normalized_skeleton(two)
    return F.when(a == b, 0.0).otherwise(F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def compatible(one: Column, two: Column) -> Column:
    """Whether two token types may share a position: equal, or both letters."""
    letters = ("upper", "lower", "alpha")
    return (one == two) | (one.isin(*letters) & two.isin(*letters))
