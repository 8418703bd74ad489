"""Queries of the numbered operators: (spark, sf_dir) -> DataFrame, each over
its whole table.  ``ORACLE_SQL`` holds the DuckDB SQL of those that SQL can
express."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.sources.tables import read_table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.llm import quality

    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    model = quality.train(docs, quality.ratings_of(read_table(spark, sf_dir, "labels")), quality.N_GRADES)
    rated = quality.score(docs, model, keep_text=False)
    tails = [F.try_element_at("tails", F.lit(k)).alias(f"p_grade_{k}") for k in range(1, quality.N_GRADES)]
    return rated.select("doc_id", "expected_grade", *tails, quality.keep().alias("keep"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.llm.page_text import extract

    return extract(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"])).select("page_id", "url", "text", "n_chars")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.llm.packing import pack

    pieces = pack(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), _vocabulary("byte_bpe_50k.json"), keep_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.llm.suffix_dedup import dedup

    return dedup(read_table(spark, sf_dir, "documents", ["doc_id", "text"])).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.llm import warc

    files = warc.write(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]), warc.new_folder(spark))
    return warc.read(files, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.llm.winnowing import compare_edited

    return compare_edited(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op7_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.llm.minhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.llm.bpe import roundtrip_digests

    return roundtrip_digests(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), _vocabulary("byte_bpe_50k.tiktoken"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.llm import secret_scan as secrets

    found = secrets.scan(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, secrets.BASE), F.sha2(secrets.joined(F.col("spans"), secrets.BASE), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op10_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.llm.topk import quantized, top_k

    vectors = quantized(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]))
    return top_k(vectors, vectors.where(F.pmod("vec_id", F.lit(100)) == 0))


def op11_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.llm.slots import shard

    placed, _ = shard(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.llm import merkle

    docs = read_table(spark, sf_dir, "documents", list(merkle.FIELDS))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = merkle.digest(*[F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars")) if c == "n_chars" else c for c in merkle.FIELDS])
    return merkle.verify(docs, tampered).select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.llm.collocations import collocations

    return collocations(read_table(spark, sf_dir, "documents", ["lang", "text"]))


QUERIES = {f.__name__: f for f in (op1_ordinal_quality, op2_html_text, op3_packing, op4_suffix_dedup, op5_warc, op6_winnowing, op7_bag_minhash, op8_byte_bpe, op9_secret_scan, op10_pivot_topk, op11_virtual_slots, op12_merkle_manifest, op13_collocations)}
ORACLE_SQL: dict[str, str] = {
    "op10_pivot_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op4_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents),
        w AS (SELECT doc_id, i AS start, substr(h, 2 * i + 1, 200) AS s FROM d, unnest(range(0, n_bytes - 99)) AS t(i)),
        r AS (SELECT doc_id, start, row_number() OVER (PARTITION BY s ORDER BY doc_id, start) AS nth FROM w),
        g AS (SELECT doc_id, start, CASE WHEN start - lag(start) OVER (PARTITION BY doc_id ORDER BY start) <= 100 THEN 0 ELSE 1 END AS opens FROM r WHERE nth > 1),
        k AS (SELECT doc_id, start, sum(opens) OVER (PARTITION BY doc_id ORDER BY start) AS run FROM g),
        x AS (SELECT doc_id, run, min(start) AS b, max(start) + 100 AS e FROM k GROUP BY ALL),
        y AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS from_ FROM x),
        z AS (SELECT doc_id, CAST(sum(e - b) AS BIGINT) AS n_removed, count(*) AS n_spans, max(e) AS last_e, string_agg(substr(h, 2 * from_ + 1, 2 * (b - from_)), '' ORDER BY b) AS head
              FROM y JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last_e, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN z USING (doc_id)""",
    "op7_bag_minhash": """
        WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM documents),
        reps AS (SELECT array_to_string(w, ' ') AS words, min(doc_id) AS rep, any_value(w) AS w FROM t GROUP BY 1),
        s AS (SELECT rep, shingle, count(*) AS n FROM (SELECT rep, unnest(CASE WHEN len(w) < 5 THEN list_filter([words], lambda x: x <> '') ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM reps) GROUP BY ALL),
        z AS (SELECT rep, sum(n) AS size FROM s GROUP BY rep),
        o AS (SELECT a.rep AS a, b.rep AS b, sum(least(a.n, b.n)) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.rep < b.rep GROUP BY ALL),
        l AS (SELECT a, b FROM o JOIN z x ON x.rep = a JOIN z y ON y.rep = b WHERE shared >= 0.8 * (x.size + y.size - shared)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        c(node, root) AS (SELECT rep, rep FROM reps UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node),
        m AS (SELECT node, min(root) AS class_id FROM c GROUP BY node)
        SELECT doc_id, rep AS rep_id, class_id FROM t JOIN reps ON array_to_string(t.w, ' ') = words JOIN m ON node = rep""",
    "op5_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
        FROM f""",
    "op12_merkle_manifest": """
        WITH RECURSIVE b AS (SELECT *, encode(CAST(doc_id AS VARCHAR)) AS id FROM documents),
        c AS (SELECT *, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, octet_length(id) + 1), lambda i: CAST(('0x' || hex(id[i:i])) AS BIGINT))),
                lambda acc, x: list_reduce(list_prepend(xor(acc, x), range(8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))) AS crc FROM b),
        f AS (SELECT doc_id, lang, coalesce(xor(crc, 4294967295) % 7 = 0, false) AS hit, n_chars, h(doc_id) || h(source) || h(lang) AS head, h(text) AS tail FROM c),
        l AS (SELECT doc_id, lang, sha256(head || h(n_chars) || tail) AS leaf, sha256(head || h(n_chars + CASE WHEN hit THEN 1 ELSE 0 END) || tail) AS tampered FROM f),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM l),
        g AS (SELECT lang, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS grp, count(*) OVER () AS n FROM (SELECT DISTINCT lang FROM l)),
        t(lang, level, idx, n, h) AS (SELECT lang, 0, idx, n, leaf FROM r UNION ALL
            SELECT lang, level + 1, idx // 2, (n + 1) // 2, sha256(h || coalesce(sib, '')) FROM (SELECT *, lead(h) OVER (PARTITION BY lang ORDER BY idx) AS sib FROM t WHERE n > 1) WHERE idx % 2 = 0),
        s AS (SELECT lang, h AS subroot FROM t WHERE n = 1),
        u(level, idx, n, h) AS (SELECT 0, grp, n, subroot FROM g JOIN s ON g.lang IS NOT DISTINCT FROM s.lang UNION ALL
            SELECT level + 1, idx // 2, (n + 1) // 2, sha256(h || coalesce(sib, '')) FROM (SELECT *, lead(h) OVER (ORDER BY idx) AS sib FROM u WHERE n > 1) WHERE idx % 2 = 0),
        p(doc_id, lang, leaf, step, idx, node, proof, upper) AS (SELECT doc_id, lang, leaf, 0, idx, tampered, '', false FROM r UNION ALL
            SELECT p.doc_id, p.lang, p.leaf, CASE WHEN z.n > 1 THEN step + 1 ELSE 0 END, CASE WHEN z.n > 1 THEN p.idx // 2 ELSE grp END,
                   CASE WHEN z.n = 1 THEN node WHEN p.idx % 2 = 0 THEN sha256(node || coalesce(y.h, '')) ELSE sha256(y.h || node) END, proof || coalesce(y.h, ''), z.n = 1
            FROM p JOIN t z ON z.lang IS NOT DISTINCT FROM p.lang AND z.level = step AND z.idx = p.idx LEFT JOIN t y ON y.lang IS NOT DISTINCT FROM p.lang AND y.level = step AND y.idx = xor(p.idx, 1)
            JOIN g ON g.lang IS NOT DISTINCT FROM p.lang WHERE NOT upper),
        q(doc_id, lang, leaf, step, idx, node, proof) AS (SELECT doc_id, lang, leaf, step, idx, node, proof FROM p WHERE upper UNION ALL
            SELECT q.doc_id, q.lang, q.leaf, step + 1, q.idx // 2, CASE WHEN q.idx % 2 = 0 THEN sha256(node || coalesce(y.h, '')) ELSE sha256(y.h || node) END, proof || coalesce(y.h, '')
            FROM q JOIN u z ON z.level = step AND z.idx = q.idx AND z.n > 1 LEFT JOIN u y ON y.level = step AND y.idx = xor(q.idx, 1)),
        e AS (SELECT * FROM q JOIN (SELECT max(level) AS last FROM u) ON step = last)
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified
        FROM e JOIN s ON s.lang IS NOT DISTINCT FROM e.lang CROSS JOIN (SELECT h AS root FROM u WHERE n = 1)""",
    "op13_collocations": """
        WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
        o AS (SELECT lang, w[i:i + k - 1] AS phrase, k FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p), range(1, 5) AS r(k) WHERE i + k - 1 <= len(w)),
        f AS (SELECT lang, phrase, k, count(*) AS f FROM o GROUP BY ALL HAVING count(*) >= 30),
        n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
        s AS (SELECT lang, phrase[i:i + m - 1] AS phrase, max(f) AS longer FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM f)) GROUP BY ALL),
        c AS (SELECT f.*, unnest(range(1, k)) AS cut FROM f LEFT JOIN s USING (lang, phrase) WHERE k >= 2 AND (longer IS NULL OR 100 * longer < 80 * f)),
        z AS (SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, CAST((2000000 * CAST(c.f AS HUGEINT)) // (x.f + y.f) AS BIGINT) AS score, cut
              FROM c JOIN f x ON x.lang = c.lang AND x.phrase = c.phrase[1:cut] JOIN f y ON y.lang = c.lang AND y.phrase = c.phrase[cut + 1:]),
        b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM z),
        k AS (SELECT lang, array_to_string(phrase, ' ') AS phrase, a, l, r, score FROM b WHERE nth = 1),
        t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM k)
        SELECT lang, rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= 2000""",
}
# the field encoding of a leaf, written out: DuckDB macros would need their own statement
ORACLE_SQL["op12_merkle_manifest"] = re.sub(r"\bh\(((?:\w+|n_chars \+ CASE WHEN hit THEN 1 ELSE 0 END))\)", r"coalesce(octet_length(encode(CAST(\1 AS VARCHAR))) || ':' || CAST(\1 AS VARCHAR), '-')", ORACLE_SQL["op12_merkle_manifest"])
