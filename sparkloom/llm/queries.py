"""The contract queries ``opN_<name>``, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, token_files
from .exact_dedup import exact_dedup
from .fingerprints import edited_by_next
from .html_wrappers import extract_text
from .line_dedup import line_dedup
from .mixing import mix_sources, taken_words
from .near_dedup import near_dedup
from .quality import classify
from .toxicity import score, train_chain


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(_table(spark, sf_dir, "documents"), all_digests=True)
    return out.withColumnRenamed("full_hash", "text_sha256")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents"), words=4, share=80)


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents whose label says that they are of good quality and not toxic."""
    return _table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0").select(F.col("doc_id").alias("_id"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain: low quality, then toxic."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return score(docs, train_chain(docs, labels, ["low_quality", "toxic"])).drop("text")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_by_next(_table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.new_folder(spark)
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=2)
    return token_files.token_table(spark, path)


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = taken_words(*mix_sources(_table(spark, sf_dir, "documents")))
    return out.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", "taken", "first_slot")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source stands for its host."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup(docs, host="source").select("doc_id", "source", "n_lines", "n_dropped", F.col("text").alias("clean_text"))


def digests(decoded: DataFrame) -> DataFrame:
    n = (F.octet_length("ids") / 4).cast("long")
    return decoded.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(bpe.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path()))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": op1_html,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_near_dedup": op3_near_dedup,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_fingerprints": op6_fingerprints,
    "op7_token_files": op7_token_files,
    "op8_mix": op8_mix,
    "op9_line_dedup": op9_line_dedup,
    "op10_bpe": op10_bpe,
}

_SIZE = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

SQL: dict[str, str] = {
    "op2_exact_dedup": """
        WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS content FROM documents),
        g AS (SELECT *, max(doc_id) OVER (PARTITION BY content) AS keep_id, count(*) OVER (PARTITION BY content) AS group_size FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    "op8_mix": f"""
        WITH d AS (SELECT doc_id, source, {_SIZE} AS size, md5(CAST(doc_id AS VARCHAR)) AS k FROM documents),
        p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d),
        s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w, 3.0::DOUBLE * source_size AS lim FROM s),
        o AS (SELECT *, (SELECT sum(source_size) FROM s)::DOUBLE AS total, sum(w) OVER () AS ws,
            coalesce(sum(lim) OVER (ORDER BY lim / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pl,
            coalesce(sum(w) OVER (ORDER BY lim / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pw FROM w),
        f AS (SELECT *, lim / w <= (total - pl) / (ws - pw) AS full_ FROM o),
        t AS (SELECT *, CASE WHEN full_ THEN lim ELSE least(lim, (total - sum(CASE WHEN full_ THEN lim ELSE 0 END) OVER ()) * w
            / nullif(sum(CASE WHEN full_ THEN 0 ELSE w END) OVER (), 0)) END AS target FROM f),
        r AS (SELECT p.doc_id, p.size, p.source, p.start, t.source_size, t.target, round(t.target)::BIGINT AS words FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source),
        q AS (SELECT *, (words // source_size) * blocks + ceil((words % source_size) / 4096.0)::BIGINT AS need FROM
            (SELECT source, source_size, round(target)::BIGINT AS words, ceil(source_size / 4096.0)::BIGINT AS blocks FROM t WHERE source_size > 0)),
        h AS (SELECT *, sum(need) OVER (ORDER BY source IS NOT NULL, source) AS hi FROM q),
        n AS (SELECT max(hi)::BIGINT AS n, greatest(1, ceil(log2(max(hi))))::BIGINT AS bits FROM h),
        v AS (SELECT slot, (list_sum(list_transform(range(bits), lambda k: ((slot >> k) & 1) << (bits - 1 - k)))::DOUBLE / (1::BIGINT << bits) * n)::DOUBLE AS point FROM n, (SELECT unnest(range(n)) AS slot FROM n)),
        k AS (SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM v JOIN h ON floor(point) >= hi - need AND floor(point) < hi),
        m AS (SELECT h.source, unnest(range(coalesce(c, 0), need::BIGINT)) AS rank FROM h LEFT JOIN (SELECT source, count(*) AS c FROM k GROUP BY source) g ON h.source IS NOT DISTINCT FROM g.source),
        x AS (SELECT slot, source, rank FROM k UNION ALL SELECT n + rank, source, rank FROM m, n),
        y AS (SELECT x.slot, x.source, rank % blocks AS block, least((rank % blocks + 1) * 4096, source_size, words - rank // blocks * source_size) AS upto
            FROM x JOIN h ON x.source IS NOT DISTINCT FROM h.source WHERE rank < need),
        z AS (SELECT r.doc_id, min(slot) AS first_slot FROM r JOIN y ON r.source IS NOT DISTINCT FROM y.source AND size > 0
            AND block >= start // 4096 AND block <= (start + size - 1) // 4096 AND greatest(start, block * 4096) < least(start + size, upto) GROUP BY r.doc_id)
        SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
            CASE WHEN size = 0 THEN 0 ELSE CAST((words // source_size) * size + greatest(0, least(start + size, words % source_size) - start) AS BIGINT) END AS taken,
            CAST(first_slot AS BIGINT) AS first_slot FROM r LEFT JOIN z USING (doc_id)""",
    "op9_line_dedup": """
        WITH d AS (SELECT doc_id, source, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents),
        e AS (SELECT DISTINCT doc_id, source, trim(x, ' ') AS line FROM (SELECT doc_id, source, unnest(lines) AS x FROM d) WHERE trim(x, ' ') <> ''),
        b AS (SELECT e.source, list(line) AS marks FROM (SELECT source, line, count(*) AS n FROM e GROUP BY source, line) e
            JOIN (SELECT source, count(*) AS pages FROM d GROUP BY source) p ON e.source = p.source WHERE n >= 2 AND n >= pages * 0.07::DOUBLE GROUP BY e.source),
        k AS (SELECT doc_id, d.source, lines, list_filter(lines, lambda x: trim(x, ' ') = '' OR NOT list_contains(coalesce(marks, []), trim(x, ' '))) AS kept FROM d LEFT JOIN b ON d.source = b.source)
        SELECT doc_id, source, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped, coalesce(array_to_string(kept, chr(10)), '') AS clean_text FROM k""",
}
