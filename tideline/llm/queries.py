"""The registered queries of the text operators, and their expected results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.bpe import encode
from tideline.llm.chat_format import format_chats, read_back
from tideline.llm.common import table
from tideline.llm.exact_dedup import exact_groups
from tideline.llm.hmm import score_texts
from tideline.llm.importance import resample
from tideline.llm.line_dedup import line_bitmaps
from tideline.llm.packing import pack
from tideline.llm.phrases import phrases
from tideline.llm.pipeline import run as pipeline
from tideline.llm.prefix_trie import numbered, prefix_nodes, rebuilt
from tideline.llm.quality import quality
from tideline.llm.simhash import near_duplicates
from tideline.llm.suffix_dedup import remove_repeats
from tideline.llm.warc import read_archives, write_pages
from tideline.scratch import scratch_path


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_pages(table(spark, sf_dir, "pages"), path)
    records = read_archives(spark, path).where("kind = 'record'")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_groups(table(spark, sf_dir, "documents"), with_text=True)
    return out.select(
        F.col("_id").alias("doc_id"), "keep_id", "group_size", "kept",
        F.sha2("_text", 256).alias("text_sha256"),
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)
    return out.select(
        F.col("_id").alias("doc_id"),
        F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def op5_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    out = score_texts(table(spark, sf_dir, "documents"), held_out=held_out)
    return out.withColumnRenamed("_id", "doc_id")


def op6_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return resample(table(spark, sf_dir, "documents"), good).withColumnRenamed("_id", "doc_id")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return out.withColumnRenamed("_id", "doc_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept", "log_perplexity",
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    sample = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame(
        [(-7, 0, "user", sample), (-7, 1, "assistant", sample)], "conv_id long, turn long, role string, text string"
    )
    return read_back(format_chats(chats.union(more))).withColumnRenamed("_id", "conv_id")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return out.withColumnRenamed("_id", "doc_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations")
    return prefix_nodes(*rebuilt(numbered(chats, "conv_id", "turn", ("role", "text"), "text")))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_bitmaps(table(spark, sf_dir, "documents"), min_docs=10, min_length=1)
    return out.select(F.col("_id").alias("doc_id"), "n_lines", "n_dropped", "kept_sha256")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(
        table(spark, sf_dir, "documents"), shortest=2, longest=3, min_count=10, cover=50, top=2000
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_warc, op3_exact_dedup, op4_simhash, op5_hmm, op6_importance,
        op7_packing, op8_quality, op9_chat_format, op10_bpe, op11_prefix_trie, op12_line_dedup,
        op13_phrases,
    )
} | {"pipeline": pipeline}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
            doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        WINDOW w AS (PARTITION BY t)
    """,
    "op11_prefix_trie": """
        WITH own AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos,
                coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations WHERE conv_id IS NOT NULL
        ), ids AS (
            SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(
                list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                lambda c, b: list_reduce(
                    list_concat([xor(c, b)], list_transform(range(8), lambda z: 0::BIGINT)),
                    lambda d, z: xor(d >> 1, 3988292384 * (d & 1))
                )
            ) , 4294967295) % 9 AS h
            FROM (SELECT DISTINCT conv_id FROM own)
        ), made AS (
            SELECT i.conv_id, 0 AS part, o.pos, o.role, o.text FROM ids i JOIN own o ON o.conv_id = i.base WHERE o.pos < i.h
            UNION ALL
            SELECT i.conv_id, 1, o.pos, o.role, o.text FROM ids i JOIN own o ON o.conv_id = i.conv_id WHERE o.pos >= i.h
        ), turns AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d,
                {'r': role, 't': text} AS turn, octet_length(encode(text)) AS size
            FROM made
        ), lists AS (
            SELECT i.conv_id, coalesce(list(t.turn ORDER BY t.d) FILTER (t.d IS NOT NULL), []) AS l,
                count(t.d) AS len
            FROM ids i LEFT JOIN turns t USING (conv_id) GROUP BY i.conv_id
        ), paths AS (
            SELECT l.conv_id, g.d AS depth, sha256(list_slice(l.l, 1, g.d)::VARCHAR || '#' || g.d) AS node,
                CASE WHEN g.d > 0 THEN sha256(list_slice(l.l, 1, g.d - 1)::VARCHAR || '#' || (g.d - 1)) END AS up,
                coalesce(t.size, 0) AS size, l.len
            FROM lists l, unnest(range(l.len + 1)) g(d) LEFT JOIN turns t ON t.conv_id = l.conv_id AND t.d = g.d
        ), nodes AS (
            SELECT node, any_value(depth) AS depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs,
                any_value(size) AS size,
                sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len = depth), '')) AS ends_sha256
            FROM paths GROUP BY node
        ), kids AS (
            SELECT up AS node, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up
        ), full_nodes AS (
            SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (node)
        ), sums AS (
            SELECT a.node, count(*) FILTER (v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.size) AS saved_tokens
            FROM full_nodes v JOIN paths a ON a.conv_id = v.conv_id AND a.depth <= v.depth
            GROUP BY a.node
        )
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves,
            s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
        FROM full_nodes n JOIN sums s USING (node) LEFT JOIN nodes p ON p.node = n.up
    """,
    "op12_line_dedup": """
        WITH docs AS (
            SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), lines AS (
            SELECT r, n, lines[n] AS line,
                translate(regexp_replace(lines[n], '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                    '{upper}', '{lower}') AS key
            FROM (SELECT r, lines, unnest(range(1, len(lines) + 1)) AS n FROM docs)
        ), common AS (
            SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10
        ), kept AS (
            SELECT r, count(*) AS n_kept, string_agg(line, chr(10) ORDER BY n) AS text
            FROM lines WHERE key NOT IN (SELECT key FROM common) GROUP BY r
        )
        SELECT doc_id, len(lines)::BIGINT AS n_lines, len(lines) - coalesce(n_kept, 0) AS n_dropped,
            sha256(coalesce(text, '')) AS kept_sha256
        FROM docs LEFT JOIN kept USING (r)
    """.replace("{upper}", _UPPER).replace("{lower}", _LOWER),
    "op13_phrases": """
        WITH pieces AS (
            SELECT lang, row_number() OVER () AS p, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w
            FROM (
                SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                    translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
                FROM documents
            )
        ), starts AS (
            SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces
        ), grams AS (
            SELECT lang, list_slice(w, i, i + m - 1) AS g, m, count(*)::HUGEINT AS f
            FROM starts, unnest([1, 2, 3]) AS s(m) WHERE i + m - 1 <= len(w) GROUP BY lang, g, m
        ), totals AS (
            SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE m = 1 GROUP BY lang
        ), found AS (
            SELECT lang, g, m, f AS a FROM grams WHERE m >= 2 AND f >= 10
        ), parts AS (
            SELECT lang, list_slice(g, 1, 2) AS g, a FROM found WHERE m = 3
            UNION ALL SELECT lang, list_slice(g, 2, 3), a FROM found WHERE m = 3
        ), covered AS (
            SELECT f.lang, f.g FROM found f JOIN (SELECT lang, g, max(a) AS most FROM parts GROUP BY lang, g) p
            USING (lang, g) WHERE 100 * p.most >= 50 * f.a
        ), kept AS (
            SELECT lang, g, m, a, array_to_string(g, ' ') AS phrase FROM found ANTI JOIN covered USING (lang, g)
        ), halves AS (
            SELECT lang, phrase, a, k, array_to_string(list_slice(g, 1, k), ' ') AS x,
                array_to_string(list_slice(g, k + 1, m), ' ') AS y
            FROM kept, unnest([1, 2]) AS cut(k) WHERE k < m
        ), counts AS (
            SELECT lang, array_to_string(g, ' ') AS s, f FROM grams WHERE m < 3 AND f >= 10
        ), cuts AS (
            SELECT h.lang, h.phrase, h.a, h.k, x.f AS l, y.f AS r, (1000000 * h.a * h.a) // (x.f * y.f) AS score
            FROM halves h JOIN counts x ON x.lang = h.lang AND x.s = h.x JOIN counts y ON y.lang = h.lang AND y.s = h.y
        ), best AS (
            SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
            phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
        FROM best JOIN totals USING (lang)
        QUALIFY rank <= 2000
    """.replace("{upper}", _UPPER).replace("{lower}", _LOWER),
}
