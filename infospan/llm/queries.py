"""The queries of the training-data operators: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from infospan.llm import digest, exact_dedup, langid, line_dedup, mixture, packing, prefix_trie, rans, secrets, simhash, vector_codes, warc, window_packing
from infospan.llm.shared import NOT_SPACE, written
from infospan.llm.tokens import public_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", words=3, budget=3)
    return found.select("doc_id", simhash.hex16(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"), "doc_id", "text")


OP1_SQL = """
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
           FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeats(table(spark, sf_dir, "documents"), "doc_id", "text", lines=3).select("doc_id", "n_lines", "n_removed", "text")


OP2_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, p, l[p + 1] || chr(10) || l[p + 2] || chr(10) || l[p + 3] AS k
      FROM (SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS p FROM d WHERE len(l) > 2)),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS rn FROM w),
c AS (SELECT DISTINCT doc_id, p + o AS i FROM f, (VALUES (0), (1), (2)) AS t(o) WHERE rn > 1),
s AS (SELECT doc_id, l[i + 1] AS line, i FROM (SELECT doc_id, l, unnest(range(0, len(l))) AS i FROM d)),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n FROM s ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(d.l)::INT AS n_lines, (len(d.l) - coalesce(k.n, 0))::INT AS n_removed, coalesce(k.text, '') AS text
FROM d LEFT JOIN k USING (doc_id)
"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"), id_col="page_id", url_col="url", payload_col="html", least=0)
    return read.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS response FROM pages),
b AS (SELECT *, array_to_string(list_transform(string_split(sha1(payload), ''), lambda c:
        ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][instr('0123456789abcdef', c)]), '') AS bits
      FROM p)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + list_sum(list_transform(range(0, 5), lambda j: substr(bits, 5 * i + j + 1, 1)::INT << (4 - j)))::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM b
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(langid.fold() != 0), "doc_id", "text", "lang")
    found = langid.predict(docs, model, "doc_id", "text")
    return found.select("doc_id", (langid.fold() == 0).alias("held_out"), "lang_pred", "score")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), capacity=1024, end_id=2, carry={"ids_crc32": F.crc32("ids")})
    return packed.places.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"CAST(size(filter(found, s -> s.kind = '{k}')) AS BIGINT) AS n_{k}") for k in ("assign", "access", "hex")]
    spans = secrets.listed(F.col("found"))
    return found.select("doc_id", *counts, F.sha2(spans.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))


OP7_SQL = """
WITH r(kind, pattern, grp, least, rank) AS (VALUES
  ('assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6, 0),
  ('access', 'AKIA[A-Z0-9]+', 0, 20, 1), ('hex', '[0-9a-f]+', 0, 24, 2)),
m AS (SELECT doc_id, kind, least, rank, generate_subscripts(ms, 1) AS i, unnest(ms) AS m, unnest(ps[:len(ms)]) AS p, unnest(vs) AS v
      FROM (SELECT doc_id, kind, least, rank, regexp_extract_all(text, pattern) AS ms, string_split_regex(text, pattern) AS ps,
                   CASE WHEN kind = 'assign' THEN regexp_extract_all(text, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2)
                        ELSE regexp_extract_all(text, pattern) END AS vs
            FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents), r)),
e AS (SELECT *, sum(length(p) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i)::BIGINT AS e FROM m),
k AS (SELECT doc_id, kind, rank, e - length(m) AS s, e FROM e WHERE length(v) >= least),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN g USING (doc_id)
"""


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(NOT_SPACE)), F.lit(0)).cast("long").alias("size"))
    mixed = mixture.mix(written(sized, "sizes"), weights=[3, 1, 2], share=1.5, most=2)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP8_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || doc_id), 1, 15))::BIGINT AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w
      FROM d GROUP BY source),
-- Sources stop in the order of size over weight: n of them have stopped where the next one stays below twice its size.
o AS (SELECT *, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS n,
             sum(2.0 * source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) - 2.0 * source_size AS stopped,
             sum(w) OVER (ORDER BY source_size / w DESC, source DESC NULLS FIRST ROWS UNBOUNDED PRECEDING) AS open_w FROM s),
cut AS (SELECT min(n) AS n, arg_min((1.5 * (SELECT sum(source_size) FROM s) - stopped) / open_w, n) AS unit FROM o
        WHERE w * (1.5 * (SELECT sum(source_size) FROM s) - stopped) / open_w <= 2.0 * source_size),
t AS (SELECT source, source_size, CASE WHEN o.n < cut.n THEN 2.0 * source_size ELSE w * unit END AS target FROM o, cut),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS aim,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY u, doc_id ROWS UNBOUNDED PRECEDING) - d.size AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (aim // source_size + CASE WHEN 2 * before + size < 2 * (aim % source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = digest.edited_neighbours(table(spark, sf_dir, "documents"), "doc_id", "text")
    edited = F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    return found.select("doc_id", "n_chars", edited, "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op10_rans_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rans.round_trip(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"), end_id=2)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.code(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    digits = F.array_join(F.transform("entry", lambda k: F.lower(F.lpad(F.hex(k), 2, "0"))), "")
    found = vector_codes.with_label_errors(coded.rows)
    return found.select(F.col("id").alias("vec_id"), digits.alias("code"), "error", "label_error", F.lit(coded.book.sha256()).alias("codebooks_sha256"))


def _op11_sql() -> str:
    steps = []
    for r in range(7):
        book = f"c{r}"
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, p, v, arg_min(k, (d, k)) AS k, min(d) AS d
      FROM (SELECT x.vec_id, x.p, x.v, b.k, list_sum(list_transform(list_zip(x.v, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
            FROM x JOIN {book} b ON b.p = x.p) GROUP BY vec_id, p, v)""")
        if r < 6:
            steps.append(f"""
m{r} AS (SELECT p, k, list(m ORDER BY i) AS e
       FROM (SELECT p, k, i, ((sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
             FROM (SELECT p, k, unnest(v) AS c, unnest(range(len(v))) AS i FROM a{r}) GROUP BY p, k, i) GROUP BY p, k),
c{r + 1} AS MATERIALIZED (SELECT c.p, c.k, coalesce(m.e, c.e) AS e FROM {book} c LEFT JOIN m{r} m USING (p, k))""")
    return f"""
WITH n AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor(4096 * c::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c)))),
x AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // 8 + 1 : (p + 1) * len(v) // 8] AS v FROM n, range(8) AS t(p)),
c0 AS (SELECT p, k - 1 AS k, v AS e FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS k FROM x) WHERE k <= 16),{",".join(steps)},
w AS (SELECT vec_id, string_agg(printf('%02x', k::INT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a6 GROUP BY vec_id),
s AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, k)) AS h FROM c6)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT h FROM s) AS codebooks_sha256
FROM w JOIN n USING (vec_id)
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = prefix_trie.turn_arrays(table(spark, sf_dir, "conversations"))
    turns = F.crc32(F.col("id").cast("string").cast("binary")) % 9
    return prefix_trie.trie(prefix_trie.grafted(arrays, F.col("id") - F.col("id") % 5, turns, most=8))


OP12_SQL = """
WITH t AS (SELECT conv_id, list({'r': coalesce(role, ''), 'x': coalesce(text, '')}
                                ORDER BY turn NULLS FIRST, substr(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS ts
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
-- CRC-32 by bits: -1 stands for one step of the shift register, other numbers are the bytes of the decimal id.
h AS (SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) % 9 AS h FROM t),
r AS (SELECT conv_id, coalesce(b.ts[1:h], []) || t.ts[h + 1:] AS ts FROM t JOIN h USING (conv_id) LEFT JOIN (SELECT conv_id AS base, ts FROM t) b ON b.base = conv_id - conv_id % 5),
p AS (SELECT conv_id, d, ts[1:d] AS pre, len(ts) AS n FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM r)),
v AS MATERIALIZED (SELECT pre, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM p GROUP BY pre, d),
c AS (SELECT pre[1:d - 1] AS pre, d - 1 AS d, count(*) AS n_children FROM v WHERE d > 0 GROUP BY ALL),
w AS MATERIALIZED (SELECT v.*, coalesce(n_children, 0) AS n_children, CASE WHEN v.d > 0 THEN (n_convs - 1) * strlen(v.pre[v.d].x) ELSE 0 END AS own FROM v LEFT JOIN c USING (pre, d)),
s AS (SELECT pre[1:e] AS pre, e AS d, sum(own)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM w) GROUP BY ALL)
SELECT w.conv_id, w.d AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, w.ends_sha256
FROM w JOIN s USING (pre, d) LEFT JOIN v u ON u.d = w.d - 1 AND u.pre = w.pre[1:w.d - 1]
"""


def op13_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = window_packing.pack(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"), capacity=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_warc": op3_warc,
    "op4_language_id": op4_language_id,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_simhash": op6_simhash,
    "op7_secret_scan": op7_secret_scan,
    "op8_mixture": op8_mixture,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_rans_ids": op10_rans_ids,
    "op11_vector_codes": op11_vector_codes,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_window_packing": op13_window_packing,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": OP1_SQL,
    "op2_line_dedup": OP2_SQL,
    "op3_warc": OP3_SQL,
    "op7_secret_scan": OP7_SQL,
    "op8_mixture": OP8_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op11_vector_codes": _op11_sql(),
}
