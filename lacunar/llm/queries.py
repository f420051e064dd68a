"""The opN queries: each applies its operator with production parameters to its whole table and derives the digest columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprint, langid, toxicity, warc
from .common import held_out, shared_dir, table
from .embeddings import link_embeddings
from .filteraudit import filter_audit
from .lexical import ranked_search
from .linededup import dedup_lines
from .mixing import mix
from .outliers import quality_rules
from .sharding import shard_rows
from .simhash import near_duplicates


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "base", "lo", "hi")


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(table(spark, sf_dir, "embeddings"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives go to the shared folder. Responses are read with their payloads, whose size and digest are taken anew;
    revisits by their headers alone. Pages with a null id come back as responses with a null id."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(warc.page_records(table(spark, sf_dir, "pages").select("page_id", "url", "html"), nameless=True), path)
    number = lambda c: F.regexp_extract(c, r"page:(-?\d+)>", 1).try_cast("long")
    full = warc.read_warc(spark, path, ["record_id", "record_type", "payload"]).where("record_type = 'response'")
    full = full.select("record_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("string").alias("refers_to"))
    again = warc.read_warc(spark, path, ["record_id", "record_type", "refers_to", "payload_digest", "full_length"]).where("record_type = 'revisit'")
    again = again.select("record_id", F.col("full_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), "record_type", "refers_to")
    return full.unionByName(again).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `rows`. Equal texts are a group only in that they share size and text_crc32: their rows are dealt one by one, since a group may be larger than a shard."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard_rows(rows, 24).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact digest's likeness is 1 for equal canonical forms and else 0. The forms of a text and its edited text are
    compared byte by byte here, those of two documents by the operator."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = fingerprint.digests(docs)
    bad = fingerprint.colliding(docs, known=known)
    if bad:  # several forms under one digest: all digests again, these with more to them
        known = fingerprint.digests(docs, bad=bad)
    rows = fingerprint.with_next(docs, known=known)
    rows = rows.select("doc_id", "text", "n", "d", "next_d", fingerprint.edited_text(F.col("text"), F.col("n"), F.col("head")).alias("edited"))
    rows = rows.withColumn("form", fingerprint.canonical(F.col("edited"))).withColumn("edited_d", fingerprint.told_apart(fingerprint.digest(F.col("form")), F.col("form"), bad))
    near = F.when(F.col("d") != F.col("edited_d"), F.lit(False)).otherwise(fingerprint.canonical(F.col("text")) == F.col("form"))
    return rows.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.col("d").alias("fingerprint"),
        F.col("edited_d").alias("edited_fingerprint"), near.cast("double").alias("near_edited"), (F.col("d") == F.col("next_d")).cast("double").alias("near_next"),
    )


def op9_bpe(spark: SparkSession, sf_dir: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Rank file and pattern are parameters; by default those of the multilingual public vocabulary, whose pattern lets no
    match run on into a blank."""
    import public_tokenizers

    ranks = bpe.load_ranks(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, ranks, pattern or public_tokenizers.PATTERN, blanks=pattern is None)
    return bpe.with_bytes(ids, ranks).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(bpe.joined_ids(F.col("ids")).cast("binary"), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.predict(docs, langid.fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of benchmark against all documents."""
    return ranked_search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return filter_audit(docs, table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_simhash, op3_mixing, op4_embeddings, op5_line_dedup, op6_warc, op7_sharding, op8_fingerprint, op9_bpe, op10_langid, op11_quality_rules, op12_lexical_search, op13_filter_audit)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: Power-of-two widths, the candidates for every seat, and the seats with the highest quotients.
_MIX = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                  CAST('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null:' || coalesce(text, ''))), 1, 15) AS BIGINT) AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS size, count(*) AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) AS i FROM d GROUP BY source),
s1 AS (SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 512 * n // (sum(n) OVER ()) - 1 AS x FROM s0),
s2 AS (SELECT *, sum(size) OVER () AS total,
              coalesce(sum(3 * size) OVER (ORDER BY size / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
              sum(w) OVER (ORDER BY size / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM s1),
lv AS (SELECT total - capped AS rest, open_w AS open FROM s2 WHERE (total - capped) * w <= 3 * size * open_w ORDER BY size / w, i LIMIT 1),
s AS (SELECT source, i, size, least(3 * size, rest * w / open)::DOUBLE AS target,
             CASE WHEN x < 1 THEN 1 WHEN x < 2 THEN 2 WHEN x < 4 THEN 4 WHEN x < 8 THEN 8 WHEN x < 16 THEN 16 WHEN x < 32 THEN 32 WHEN x < 64 THEN 64 WHEN x < 128 THEN 128 WHEN x < 256 THEN 256 ELSE 512 END AS width FROM s2, lv),
b AS (SELECT CAST(least(1024, greatest(1, floor(min(target) FILTER (target > 0) / 10000))) AS BIGINT) AS block FROM s),
c AS (SELECT s.i, d.h % s.width AS k, sum(d.size)::BIGINT AS size, CAST(ceil(sum(d.size) / max(block)) AS BIGINT) AS n FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, b GROUP BY ALL),
room AS (SELECT i, sum(3 * n) AS room FROM c GROUP BY i),
q1 AS (SELECT i, row_number() OVER (ORDER BY target / (2 * q + 1) DESC, i) AS place FROM (SELECT s.i, s.target, unnest(range(room::BIGINT)) AS q FROM s JOIN room USING (i) WHERE target > 0)),
quota AS (SELECT i, count(*) AS quota FROM q1, b WHERE place <= (SELECT (2 * sum(size) + max(block)) // (2 * max(block)) FROM s, b) GROUP BY i),
q2 AS (SELECT i, k, row_number() OVER (PARTITION BY i ORDER BY size::DOUBLE / (2 * q + 1) DESC, k) AS place FROM (SELECT i, k, size, unnest(range(3 * n)) AS q FROM c WHERE size > 0)),
seats AS (SELECT i, k, count(*) AS q FROM q2 JOIN quota USING (i) WHERE place <= quota GROUP BY ALL),
plan AS (SELECT c.i, c.k, CASE WHEN n > 0 THEN coalesce(q, 0) // n ELSE 0 END AS base, CASE WHEN n > 0 THEN coalesce(q, 0) % n * block ELSE 0 END AS extra FROM c LEFT JOIN seats USING (i, k), b),
r AS (SELECT d.*, s.i, s.size AS source_size, s.target, base, extra,
             coalesce(sum(d.size) OVER (PARTITION BY s.i, plan.k ORDER BY h, doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source JOIN plan ON plan.i = s.i AND plan.k = d.h % s.width)
SELECT doc_id, size, source_size, target, source, base::BIGINT AS base, 0::BIGINT AS lo, least(greatest(extra - pos, 0), size)::BIGINT AS hi,
       (base * size + least(greatest(extra - pos, 0), size))::BIGINT AS taken FROM r"""

SQL = {
    "op3_mixing": _MIX,
    "op12_lexical_search": rf"""
WITH tok AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
len AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id),
s AS (SELECT count(*) AS N0, sum(n)::BIGINT AS L0 FROM len),
p AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * N0 + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, s GROUP BY term, N0),
q AS (SELECT item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
b AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
r AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * N0) // L0))))::BIGINT AS score
      FROM b JOIN w USING (term) JOIN p USING (term) JOIN len USING (doc_id), s GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20""",
    "op13_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
low AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY text),
f AS (SELECT d.part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x
               WHEN 'A' THEN len(words) < 50 WHEN 'B' THEN 100 * len(list_distinct(words)) < 65 * len(words)
               WHEN 'C' THEN 100 * len(regexp_extract_all(d.text, '[A-Z]')) > 5 * length(d.text)
               WHEN 'D' THEN regexp_matches(d.text, '[#$%&*|]') ELSE coalesce(d.doc_id > first_id, false) END) AS fails
      FROM d JOIN low USING (text) LEFT JOIN lab USING (doc_id)),
x(l) AS (SELECT unnest(['A', 'B', 'C', 'D', 'E'])),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
s AS (SELECT filter_order, k::INTEGER AS step, filter_order[k] AS l, string_split(filter_order[1:k-1], '') AS before FROM o, range(1, 6) t(k)),
r AS (SELECT part, filter_order, step, l,
             count(*) FILTER (NOT list_contains(fails, l) AND NOT list_has_any(fails, before)) AS kept,
             count(*) FILTER (list_contains(fails, l) AND NOT list_has_any(fails, before)) AS removed,
             count(*) FILTER (list_contains(fails, l) AND list_has_any(fails, before)) AS redundant,
             count(*) FILTER (fails = [l]) AS unique_fails,
             count(*) FILTER (good = 1 AND list_contains(fails, l) AND NOT list_has_any(fails, before)) AS good_lost,
             count(*) FILTER (toxic = 1 AND list_contains(fails, l) AND NOT list_has_any(fails, before)) AS toxic_lost
      FROM f, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, l)::BIGINT AS shapley FROM r""",
    "op4_embeddings": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
lk AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, lk.b FROM r JOIN lk ON r.b = lk.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM lk GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
    "op6_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f""",
    "op5_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (SELECT *, {_LOWER.format(f"trim(line, {_WHITE})")} AS k FROM lines),
rep AS (SELECT k, max(doc_id) AS first_id FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (first_id IS NOT NULL AND doc_id < first_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (first_id IS NULL OR doc_id >= first_id), '')) AS kept_sha256
FROM keyed LEFT JOIN rep USING (k) GROUP BY doc_id""",
}
