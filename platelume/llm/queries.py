"""The thin queries opN_<name> over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, codes, decontaminate, exact_dedup, html_text, language, pieces, quality, sharding, simhash, toxicity, trie
from .common import table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages, html_text.train(pages), html_stays=False)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs).drop("text")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), text_stays=False)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs.select("doc_id", "text"), language.train(docs), text_stays=False)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")), text_stays=False)


def op6_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=40, text_stays=False)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(rows.unionByName(extra)), sort=False)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), text_stays=False)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, text_stays=False)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, text_stays=False)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return codes.fit(rows)[0].drop("label")


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), text_stays=False)


QUERIES = {f.__name__: f for f in (op1_html_text, op2_exact_dedup, op3_toxicity, op4_language, op5_quality, op6_jump_shards, op7_chat_format, op8_decontaminate, op9_byte_bpe, op10_simhash, op11_prefix_trie, op12_vector_codes, op13_pieces)}



def _codes_sql(rounds: int = 2) -> str:
    """Every part against every entry, for each round and once more; parts of four components."""
    xs = ("x1", "x2", "x3", "x4")
    gap = " + ".join(f"(a.{x} - b.{x}) * (a.{x} - b.{x})" for x in xs)
    steps = ["""kept AS (
            SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)""",
        "parts AS MATERIALIZED (SELECT r, p, " + ", ".join(f"v[4 * p + {j + 1}] AS {x}" for j, x in enumerate(xs)) + " FROM kept CROSS JOIN range(16) t(p))",
        "book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x1, x2, x3, x4 FROM parts WHERE r <= 64)"]
    for n in range(rounds + 1):
        steps.append(f"near{n} AS MATERIALIZED (SELECT a.r, a.p, min(({gap}) * 64 + b.e) AS k FROM parts a JOIN book{n} b USING (p) GROUP BY a.r, a.p)")
        if n < rounds:
            mean = ", ".join(f"coalesce(s.{x}, b.{x}) AS {x}" for x in xs)
            sums = ", ".join(f"CAST(floor(sum({x}) / count(*)) AS BIGINT) AS {x}" for x in xs)
            steps.append(f"book{n + 1} AS MATERIALIZED (SELECT b.p, b.e, {mean} FROM book{n} b LEFT JOIN (SELECT p, k % 64 AS e, {sums} FROM near{n} JOIN parts USING (r, p) GROUP BY ALL) s USING (p, e))")
    steps.append(f"coded AS (SELECT r, string_agg(printf('%02x', k % 64), '' ORDER BY p) AS code, CAST(sum(k // 64) AS BIGINT) AS error FROM near{rounds} GROUP BY r)")
    digest = f"(SELECT sha256(string_agg(concat_ws(',', x1, x2, x3, x4), ',' ORDER BY p, e)) FROM book{rounds})"
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {digest} AS codebooks_sha256 FROM kept JOIN coded USING (r)"


ORACLE = {
    # each rebuilt conversation as a list of turns, each prefix as a list; a node's ancestors are the prefixes of its least member
    "op11_prefix_trie": """
        WITH crc_table AS (SELECT list(list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
        own AS (
            SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS s
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        heads AS (
            SELECT conv_id, s, conv_id - conv_id % 5 AS base,
                   xor(list_reduce([ascii(c) for c in string_split(CAST(conv_id AS VARCHAR), '')], lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8), CAST(4294967295 AS BIGINT)), 4294967295) % 9 AS h
            FROM own CROSS JOIN crc_table),
        rebuilt AS (SELECT a.conv_id AS c, list_concat(coalesce(b.s[1:a.h], []), a.s[a.h + 1:]) AS s FROM heads a LEFT JOIN own b ON b.conv_id = a.base),
        members AS MATERIALIZED (SELECT c, d, s[1:d] AS p, len(s) AS n FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM rebuilt)),
        nodes AS MATERIALIZED (
            SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '') AS ends,
                   CASE WHEN d > 0 THEN (count(*) - 1) * octet_length(encode(p[d].text)) ELSE 0 END AS saved
            FROM members GROUP BY d, p),
        node_of AS MATERIALIZED (SELECT c, m.d, conv_id FROM members m JOIN nodes USING (d, p)),
        linked AS MATERIALIZED (SELECT nodes.*, u.conv_id AS parent FROM nodes LEFT JOIN node_of u ON u.c = nodes.conv_id AND u.d = nodes.d - 1),
        children AS (SELECT parent AS conv_id, d - 1 AS d, count(*) AS n FROM linked WHERE parent IS NOT NULL GROUP BY ALL),
        sums AS (
            SELECT o.conv_id, o.d, count(*) FILTER (children.n IS NULL) AS n_leaves, sum(u.saved) AS saved
            FROM linked u LEFT JOIN children USING (conv_id, d) JOIN node_of o ON o.c = u.conv_id AND o.d <= u.d GROUP BY ALL)
        SELECT l.conv_id, l.d AS depth, parent AS parent_conv_id, n_convs, coalesce(children.n, 0) AS n_children, n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256,
               CASE WHEN l.d = 0 THEN NULL WHEN l.d <= b.n THEN base ELSE l.conv_id END AS source_conv_id,
               CASE WHEN l.d = 0 THEN NULL WHEN l.d <= b.n THEN l.d ELSE l.d - b.n + h END AS source_turn
        FROM linked l LEFT JOIN children USING (conv_id, d) JOIN sums USING (conv_id, d)
        JOIN (SELECT a.conv_id, a.base, a.h, least(a.h, coalesce(len(b.s), 0)) AS n FROM heads a LEFT JOIN own b ON b.conv_id = a.base) b ON b.conv_id = l.conv_id""",
    "op12_vector_codes": _codes_sql(),
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    # windows of each width that items have; words as in the contract; every document, every window
    "op8_decontaminate": r"""
        WITH low AS (
            SELECT 'd' AS kind, doc_id, '' AS item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
            UNION ALL SELECT 'b', 0, coalesce(CAST(item_id AS VARCHAR), ''), translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
        split AS (SELECT kind, doc_id, item_id, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM low),
        wins AS (
            SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS words
            FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM split WHERE kind = 'b' AND len(w) > 0)),
        places AS (
            SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS words
            FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM split CROSS JOIN (SELECT DISTINCT k FROM wins) WHERE kind = 'd' AND len(w) >= k)),
        found AS (SELECT doc_id, places.k, i, item_id FROM places JOIN wins USING (k, words)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM (SELECT DISTINCT doc_id, k, i FROM found)) GROUP BY 1),
        items AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY 1)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
        FROM split d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) WHERE kind = 'd'""",
    "op7_chat_format": r"""
        WITH rows AS (
            SELECT conv_id, turn, role, text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        made AS (
            SELECT conv_id, count(*) AS n_turns,
                   string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns,
                   coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (role = 'assistant'), '') AS loss,
                   sum(length('<turn ></turn>' || chr(10))
                       + length(replace(replace(replace(coalesce(role, '') || coalesce(text, ''), '\', '\\'), '<', '\l'), '>', '\g'))) AS chars
            FROM rows GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
               CAST(chars AS BIGINT) AS formatted_chars
        FROM made""",
}
