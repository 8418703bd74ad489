"""Document fingerprints by winnowing, in DataFrame functions only.

Every run of GRAM tokens has a rolling hash; of each window of WINDOW hashes in a row
the smallest is chosen, the rightmost of equal ones; the chosen hashes with
their positions are the fingerprint.  Two texts that share a passage of
GRAM + WINDOW - 1 tokens share a fingerprint entry from it.  A token is a run
without white space; of scripts that are written without blanks, a character.

A text is handled in chunks that end at white space, each with the tokens of
the next ones that its windows reach into, so the arrays of an expression
stay small however long the text is.  A run of more than CHUNK_CHARS code
points without white space counts as several tokens of that length, cut from
its start, so equal runs give equal tokens wherever they stand.  The sliding minimum is taken
by doubling: minima over 2, 4, 8 ... hashes, with the position packed below
the hash such that a later position is smaller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM, DOUBLINGS = 5, 4           # tokens of a gram; a window has 2**DOUBLINGS grams
WINDOW = 1 << DOUBLINGS
CHUNK_CHARS = 4096
_PLACES = (1 << 13) - 1          # token offsets within a chunk and its overlap
_OVERLAP = GRAM + WINDOW - 2
_CHUNK = rf"(?s).{{1,{CHUNK_CHARS}}}(?!\S)|\S{{1,{CHUNK_CHARS}}}|\s+"
# Thai, Lao, Burmese, Khmer, and the East Asian scripts
_UNSPACED = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{2E80}-\x{A4CF}\x{AC00}-\x{D7FF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
_TOKEN = rf"[^\s{_UNSPACED}]+|\S"
NO_ID = (1 << 63) - 1


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def token_chunks(text: Column) -> Column:
    """Hashes of the text's tokens, array<array<bigint>> by chunk."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_CHUNK), F.lit(0)),
                       lambda c: F.transform(F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(0)), lambda t: F.xxhash64(t)))


def _double(minima: Column, span: int) -> Column:
    """Minima over twice the span; at the end, where nothing is left to the
    right, over what there is."""
    return _let(minima, lambda a: F.zip_with(a, F.slice(a, span + 1, 1 << 30), lambda x, y: F.least(x, y)))


def _turned(x: Column, bits: int) -> Column:
    """The 64 bits of x rotated to the left."""
    return F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits)) if bits else x


def rolled(tokens: Column) -> Column:
    """Hashes of all grams of GRAM tokens by a cyclic polynomial, the rolling
    hash in which a step turns the hash by one bit, takes out the token that
    leaves and puts in the one that comes.  An expression has no running
    state, so each value is not stepped on from its neighbour but joined from
    the hashes of shorter runs that neighbours share: of 1, 2, 4 ... tokens.
    What comes behind the last gram is null."""
    def joined(x: Column, y: Column, by: int) -> Column:
        return _turned(x, by).bitwiseXOR(y)

    def twice(run: Column, length: int) -> Column:
        return _let(run, lambda a: F.zip_with(a, F.slice(a, length + 1, 1 << 30), lambda x, y: joined(x, y, length)))

    out, length = tokens, 1
    for bit in bin(GRAM)[3:]:
        out, length = twice(out, length), 2 * length
        if bit == "1":
            out, length = F.zip_with(out, F.slice(tokens, length + 1, 1 << 30), lambda x, y: joined(x, y, 1)), length + 1
    return F.slice(out, F.lit(1), F.greatest(F.size(tokens) - GRAM + 1, F.lit(0)))


def _chosen(tokens: Column, only: Column) -> Column:
    """Packed minima of the windows of some tokens, distinct and in order.
    ``only``: there are no other tokens, so fewer grams than a window count
    as one, and fewer tokens than a gram as a gram."""
    grams = F.size(tokens) - GRAM + 1

    def packed(hash_: Column, p: Column) -> Column:
        return hash_.bitwiseAND(F.lit(~_PLACES)).bitwiseOR((F.lit(_PLACES) - p).cast("long"))

    def minima() -> Column:
        out = F.transform(rolled(tokens), packed)
        for k in range(DOUBLINGS):
            out = _double(out, 1 << k)
        return out

    none = F.array().cast("array<long>")
    several = F.array_distinct(F.slice(minima(), F.lit(1), grams - WINDOW + 1))
    few = F.array(F.array_min(minima()))
    tiny = F.array(packed(F.xxhash64(tokens), F.lit(0)))
    return F.when(grams >= WINDOW, several).when(~only, none).when(grams >= 1, few).when(F.size(tokens) > 0, tiny).otherwise(none)


def entries(parts: Column) -> Column:
    """array<struct<pos, hash>> from the column of token chunks: the number
    of tokens before the gram, and the hash without its lowest bits."""
    def of_tokens(tokens: Column, only: bool) -> Column:
        return F.transform(_chosen(tokens, F.lit(only)), lambda x: F.struct((F.lit(_PLACES) - x.bitwiseAND(F.lit(_PLACES))).cast("int").alias("pos"), F.shiftright(x, 13).alias("hash")))

    def count(chunks: Column) -> Column:
        return F.aggregate(chunks, F.lit(0), lambda n, p: n + F.size(p))

    def of_chunk(i: Column) -> Column:
        following = F.get(parts, i + 1)
        rest = F.when(F.size(following) >= _OVERLAP, F.slice(following, 1, _OVERLAP)).otherwise(F.slice(F.flatten(F.slice(parts, i + 2, F.lit(_OVERLAP))), 1, _OVERLAP))
        found = _let(F.concat(F.get(parts, i), rest), lambda tokens: of_tokens(tokens, False))
        return _let(count(F.slice(parts, F.lit(1), i)), lambda n: F.transform(found, lambda e: F.struct((e["pos"] + n).alias("pos"), e["hash"].alias("hash"))))

    # windows on either side of a chunk's end may choose the same gram
    chunked = _let(F.flatten(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), of_chunk)),
                   lambda a: F.filter(a, lambda e, i: (i == 0) | (F.get(a, i - 1)["pos"] != e["pos"])))
    one = F.when(F.size(parts) == 1, F.get(parts, F.lit(0))).when(count(parts) <= _OVERLAP, F.flatten(parts))    # else null: more than a window in several chunks
    return _let(one, lambda tokens: F.when(tokens.isNotNull(), of_tokens(tokens, True)).otherwise(chunked))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; two empty ones
    are alike."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - both
    return F.when(total == 0, F.lit(1.0)).otherwise(both / total)


def as_text(found: Column) -> Column:
    """position:hash (hexadecimal), comma-joined."""
    return F.concat_ws(",", F.transform(found, lambda e: F.concat(e["pos"].cast("string"), F.lit(":"), F.lower(F.hex(e["hash"].bitwiseAND(F.lit((1 << 51) - 1)))))))


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with column ``out``, array<struct<pos, hash>>: the winnowed
    grams of each whole text in order of position.

    Equal texts have equal fingerprints.  Null, empty and blank texts have
    none; a text of fewer tokens than a gram has them as one; one with fewer
    grams than a window has its smallest gram.  A column named ``out`` is
    replaced; an empty table stays empty.  No shuffle."""
    return docs.drop(out).withColumn("__parts", token_chunks(F.col(text))).withColumn(out, entries(F.col("__parts"))).drop("__parts")


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, next_text): each document with the text of the next one
    by ascending doc_id, the last with that of the first.  Null ids come last;
    rows of equal id are ordered by the hash of their text; one row is its own
    next.

    Ranges of ids of about equal size, from quantiles, are sorted apart; the
    first document of a range is added to the range before it, where it is
    found as the next of the last one."""
    n = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), key.alias("key"))
    edges = rows.agg(F.percentile_approx("key", [k / n for k in range(1, n)], 10 * n)).first()[0] or []
    edges = sorted(set(edges))
    rows = rows.withColumn("range", F.size(F.filter(F.array(*map(F.lit, edges)) if edges else F.array().cast("array<long>"), lambda e: e <= F.col("key"))))
    heads = rows.groupBy("range").agg(F.min("key").alias("key")).orderBy("range").collect()     # a row per range
    if not heads:
        return rows.select("doc_id", "text", F.col("text").alias("next_text"))
    before = {h["key"]: heads[k - 1]["range"] for k, h in enumerate(heads)}
    tie = F.xxhash64("text")
    starts = rows.where(F.col("key").isin(list(before)))
    starts = starts.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(tie, "text"))).where("nth = 1")
    place = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("key"))
    added = starts.select("doc_id", "text", "key", place.alias("range"), F.lit(True).alias("added"))
    order = Window.partitionBy("range").orderBy("added", "key", tie, "text")
    joined = rows.select("doc_id", "text", "key", "range", F.lit(False).alias("added")).unionByName(added)
    return joined.withColumn("next_text", F.lead("text").over(order)).where("not added").select("doc_id", "text", "next_text")


def compare_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter
    of code points (rounded down) is replaced by the first as many of the next
    document: (doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next)."""
    m = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - m), F.substring(F.col("next_text"), F.lit(1), m))
    rows = with_next(docs, doc_id, text).withColumn("edited", edited)
    for name, source in (("own", "text"), ("changed", "edited"), ("following", "next_text")):
        rows = fingerprints(rows, source, name)
    hashes = {c: F.array_distinct(F.col(f"{c}.hash")) for c in ("own", "changed", "following")}
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
                       likeness(hashes["own"], hashes["changed"]).alias("near_edited"), likeness(hashes["own"], hashes["following"]).alias("near_next"))
