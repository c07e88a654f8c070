"""Document fingerprints that add up: homomorphic multiset hashes of paragraphs, in DataFrame functions only.

A paragraph (a line of the text) is hashed to a wide vector, and a document's fingerprint is the sum of its paragraphs' vectors,
each lane modulo a power of two. So the order of paragraphs does not matter, and inserting or deleting one adds or subtracts its
vector. The vector has two parts:

* 16 exact lanes modulo 2**32, from the SHA-256 of the paragraph: equal multisets of paragraphs have equal lanes;
* 64 signed lanes modulo 2**24, the sum over the paragraph's word pairs (and its last word) of +1 or -1 by each bit of the pair's
  hash. The squared length of two fingerprints' difference estimates how many pairs they do not share, which gives a likeness.

Likeness of a and b is 1 if the fingerprints are equal, else 1 - |a - b|**2 / (|a|**2 + |b|**2), at least 0. With 64 lanes its
standard error is about 0.18 for unrelated texts and falls with their likeness.

Defined cases: null text is empty; an empty text is one empty paragraph, whose signed lanes are 0; a text without words is
like equal ones only; repeated rows stand beside each other in order and may be each other's next; the last row's next is the
first, a single row's next is itself; a null doc_id comes first; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import SPACES, with_followers

EXACT, SIGNED = 16, 64
EXACT_MOD, SIGNED_MOD = 1 << 32, 1 << 24


def paragraphs(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row for each pair of neighbouring words of each paragraph: keys, pos (0 for a paragraph's first), digest, pair. A
    paragraph without words has one row without a pair."""
    lines = rows.select(*keys, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line"))
    lines = lines.select(*keys, F.unhex(F.sha2("line", 256)).alias("digest"), F.filter(F.split("line", SPACES), lambda w: w != "").alias("w"))
    pairs = F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"))
    return lines.select(*keys, "digest", F.posexplode_outer(pairs).alias("pos", "pair"))


def lanes(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, exact, signed): the two lane arrays of each key's text. Sums are combined before any exchange."""
    units = paragraphs(rows, keys, text)
    units = units.select(*keys, (F.coalesce("pos", F.lit(0)) == 0).alias("head"), "digest", F.when(F.col("pos").isNotNull(), F.xxhash64("pair.a", "pair.b")).alias("h"))
    exact = [F.sum(F.when(F.col("head"), F.xxhash64(F.lit(j), F.col("digest")).bitwiseAND(EXACT_MOD - 1))).alias(f"e{j}") for j in range(EXACT)]
    # two bits of the hash to a sum, 32 places apart
    bits = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(0x100000001)).alias(f"s{j}") for j in range(SIGNED // 2)]
    out = units.groupBy(*keys).agg(*exact, *bits, F.count("h").alias("n"))
    low = [F.coalesce(F.col(f"s{j}"), F.lit(0)).bitwiseAND(0xFFFFFFFF) for j in range(SIGNED // 2)]
    high = [F.shiftrightunsigned(F.coalesce(F.col(f"s{j}"), F.lit(0)), 32) for j in range(SIGNED // 2)]
    return out.select(*keys, F.array(*[F.col(f"e{j}") % EXACT_MOD for j in range(EXACT)]).alias("exact"), F.array(*[F.pmod(2 * c - F.col("n"), F.lit(SIGNED_MOD)) for c in low + high]).alias("signed"))


def combine(a: Column, b: Column, sign: int = 1) -> tuple[Column, Column]:
    """The lanes (exact, signed) of two fingerprints' sum, or with ``sign`` -1 of the first without the second's paragraphs."""
    one = lambda f, mod: F.zip_with(a[f], b[f], lambda x, y: F.pmod(x + sign * y, F.lit(mod)))
    return one("exact", EXACT_MOD), one("signed", SIGNED_MOD)


def squares(values: Column) -> Column:
    half = SIGNED_MOD // 2
    signed = F.transform(values, lambda x: (F.pmod(x + half, F.lit(SIGNED_MOD)) - half).cast("double"))
    return F.aggregate(signed, F.lit(0.0), lambda acc, x: acc + x * x)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two structs of lanes."""
    apart = squares(F.zip_with(a["signed"], b["signed"], lambda x, y: x - y))
    whole = squares(a["signed"]) + squares(b["signed"])
    near = F.when(whole == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - apart / whole))
    return F.when((a["exact"] == b["exact"]) & (a["signed"] == b["signed"]), F.lit(1.0)).otherwise(near)


def written(a: Column) -> Column:
    """The fingerprint as lower-case hex: 8 digits for each exact lane, 6 for each signed lane."""
    digits = lambda values, n: F.array_join(F.transform(values, lambda x: F.lpad(F.hex(x), n, "0")), "")
    return F.lower(F.concat(digits(a["exact"], 8), digits(a["signed"], 6)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("_row"), F.col("text").cast("string").alias("text"))
    out = lanes(rows, ["_row", "doc_id"], "text")
    return out.select("doc_id", written(F.struct("exact", "signed")).alias("fingerprint"))


def edited(docs: DataFrame, per_part: int = 1 << 20) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row, where the edited
    text ends with the beginning of the next row's text in place of its own last quarter."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    w = Window.partitionBy("bucket").orderBy("place")
    rows = with_followers(docs, "doc_id", ["text"], per_part).withColumn("follower", F.lead("text").over(w))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("k", F.floor(F.col("n_chars") / 4).cast("int"))
    changed = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.col("k")).cast("int")), F.substring(F.col("follower"), F.lit(1), F.col("k")))
    rows = rows.withColumn("changed", changed).withColumn("sha", F.coalesce(F.sha2("changed", 256), F.lit("")))
    keys = ["bucket", "place", "guest", "doc_id", "n_chars", "sha", "kind"]
    both = rows.select(*keys[:-1], F.posexplode(F.when(F.col("guest"), F.array("text")).otherwise(F.array("text", "changed"))).alias("kind", "body"))
    own = F.struct("exact", "signed")
    order = Window.partitionBy("bucket").orderBy("place", "kind")
    found = lanes(both, keys, "body").withColumn("own", own).withColumn("new", F.lead("own").over(order)).withColumn("next", F.lead("own", 2).over(order))
    found = found.filter("not guest and kind = 0")
    return found.select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), written(F.col("own")).alias("fingerprint"), written(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
