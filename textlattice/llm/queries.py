"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textlattice.llm import conversations, exact_dedup, filter_audit, kneser_ney, media, minhash, mixing, packing, simhash, substring_dedup, token_counts, toxicity, url_filter
from textlattice.llm.common import table

RULES = [
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kneser_ney.judged(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", "n_words", "perplexity", "threshold", "kept")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.store_texts(table(spark, sf_dir, "documents")))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    return exact_dedup.report(spark, table(spark, sf_dir, "documents"), index)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(table(spark, sf_dir, "conversations"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_quality": op3_quality,
    "op4_url_filter": op4_url_filter,
    "op5_simhash": op5_simhash,
    "op6_webp_media": op6_webp_media,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_mixing": op10_mixing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_minhash": op12_minhash,
    "op13_filter_audit": op13_filter_audit,
}

_RULE_ROWS = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)

ORACLE: dict[str, str] = {
    "op4_url_filter": f"""
        WITH parts AS (
          SELECT page_id,
            translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
          FROM pages),
        rules(verdict, h, p) AS (VALUES {_RULE_ROWS}),
        fits AS (
          SELECT parts.*, rules.verdict, h || p AS rule,
            row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || p) DESC NULLS LAST) AS k
          FROM parts LEFT JOIN rules
            ON ends_with('.' || host, '.' || h) AND starts_with(path, p))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1""",
    "op7_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op10_mixing": r"""
        WITH d AS (
          SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
            CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 9) AS BIGINT) AS h
          FROM documents),
        s AS (
          SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
          FROM d GROUP BY source),
        w AS (
          SELECT *, CAST([5, 2, 1][1 + (rank - 1) % 3] AS DOUBLE) AS weight, CAST(source_size * 3 AS DOUBLE) AS cap FROM s),
        l AS (
          SELECT *, cap / weight AS full_at,
            (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
          FROM w WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (
          SELECT source, source_size,
            least(cap, coalesce((SELECT level FROM l WHERE level <= full_at ORDER BY full_at, rank LIMIT 1), 0) * weight) AS target
          FROM l),
        r AS (
          SELECT *, CASE WHEN source_size > 0 THEN least(3, CAST(floor(target / source_size) AS BIGINT)) ELSE 0 END AS repeats FROM t),
        c AS (
          SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto
          FROM (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h)),
        e AS (
          SELECT r.*, target - repeats * source_size AS left_over,
            (SELECT min(h) FROM c WHERE c.source IS NOT DISTINCT FROM r.source AND upto > target - repeats * source_size) AS edge
          FROM r),
        x AS (
          SELECT e.*, coalesce(edge, 0) + CASE WHEN words > 0 AND words < 2 * (left_over - (upto - words)) THEN 1 ELSE 0 END AS below
          FROM e LEFT JOIN c ON c.source IS NOT DISTINCT FROM e.source AND c.h = e.edge)
        SELECT doc_id, size, source_size, target,
          CAST(size * (repeats + CASE WHEN repeats < 3 AND d.h < below THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source""",
    "op11_conversation_repair": r"""
        WITH RECURSIVE crc AS (
          SELECT list(list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
          FROM range(256) r(n)),
        r AS (
          SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
          FROM conversations),
        h AS (
          SELECT r.*, xor(list_reduce([4294967295] || list_transform(string_split(key, ''), lambda ch: CAST(ord(ch) AS BIGINT)),
            lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS hit
          FROM r, crc),
        x AS (
          SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
            CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
          FROM h, (VALUES (0), (1)) c(copy) WHERE hit <> 0 AND (copy = 0 OR hit = 3)),
        y AS (SELECT *, substr(role, 1, 1) AS init, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS j FROM x),
        z AS (
          SELECT *, lag(init) OVER (PARTITION BY conv_id ORDER BY j) || init AS pair,
            CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY j) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
          FROM y),
        m(q, r, ins, own) AS (VALUES ('-', 's', '', ''), ('-', 'u', '', 'user'), ('-', 'a', 'user:', 'assistant'), ('s', 'u', '', 'user'),
          ('s', 'a', 'user:', 'assistant'), ('u', 'a', '', 'assistant'), ('u', 'u', 'assistant:', 'user'), ('a', 'u', '', 'user'), ('a', 'a', 'user:', 'assistant')),
        o AS (
          SELECT m.*, 'K' AS edit, 0 AS price FROM m UNION ALL SELECT m.*, 'R', 3 FROM m WHERE r <> 's'
          UNION ALL SELECT q, q, '', '', 'D', 4 FROM (VALUES ('-'), ('s'), ('u'), ('a')) d(q)),
        w(conv_id, j, q, best) AS (
          SELECT DISTINCT conv_id, CAST(0 AS BIGINT), '-', {'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': ''} FROM z
          UNION ALL
          SELECT w.conv_id, z.j, o.r, min({
            'cost': CAST(best.cost + price + CASE WHEN ins <> '' THEN 3 ELSE 0 END + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END AS BIGINT),
            'audit': best.audit || CASE WHEN ins <> '' THEN 'I' ELSE '' END || edit,
            'lines': best.lines || CASE WHEN ins <> '' THEN ins || chr(10) ELSE '' END
              || CASE edit WHEN 'D' THEN '' WHEN 'K' THEN role || ':' || text || chr(10) ELSE own || ':' || text || chr(10) END})
          FROM w JOIN z ON z.conv_id IS NOT DISTINCT FROM w.conv_id AND z.j = w.j + 1 JOIN o ON o.q = w.q
          WHERE edit = 'D' OR (fault IN ('', 'truncated') AND (edit = 'R' OR init = o.r))
          GROUP BY w.conv_id, z.j, o.r),
        n AS (
          SELECT conv_id, max(j) AS n, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
            count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
            count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
          FROM z GROUP BY conv_id),
        e(q, ins, lines) AS (VALUES ('-', '', ''), ('s', 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), ('u', 'I', 'assistant:' || chr(10)), ('a', '', '')),
        f AS (
          SELECT w.conv_id, min({'cost': best.cost + 3 * length(ins), 'audit': best.audit || ins, 'lines': best.lines || e.lines}) AS best
          FROM w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.n = w.j JOIN e ON e.q = w.q GROUP BY w.conv_id)
        SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
          coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit,
          sha256(regexp_replace(coalesce(best.lines, ''), '\n\z', '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) i
          LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM i.conv_id""",
    "op12_minhash": r"""
        WITH RECURSIVE d AS (
          SELECT row_number() OVER () AS r, doc_id,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
          FROM documents),
        s AS MATERIALIZED (
          SELECT r, doc_id, list_sort(CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) END) AS sh
          FROM d),
        u AS MATERIALIZED (SELECT sh, len(sh) AS n, row_number() OVER () AS id FROM (SELECT DISTINCT sh FROM s WHERE len(sh) > 0)),
        x AS MATERIALIZED (SELECT id, n, unnest(sh) AS g FROM u),
        f AS (SELECT g, count(*) AS c FROM x GROUP BY g),
        p AS MATERIALIZED (
          SELECT id, n, g FROM (SELECT id, n, x.g, row_number() OVER (PARTITION BY id ORDER BY c, x.g) AS k FROM x JOIN f ON f.g = x.g)
          WHERE k <= n - (80 * n + 99) // 100 + 1),
        c AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.g = b.g AND a.id < b.id WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
        i AS (SELECT a, b, ua.n + ub.n AS n, len(list_intersect(ua.sh, ub.sh)) AS same FROM c JOIN u ua ON ua.id = a JOIN u ub ON ub.id = b),
        e AS MATERIALIZED (SELECT a, b FROM i WHERE 100 * same >= 80 * (n - same) UNION ALL SELECT b, a FROM i WHERE 100 * same >= 80 * (n - same)),
        reach(id, root) AS (SELECT id, id FROM u UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.id),
        root AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
        m AS (SELECT r, doc_id, len(s.sh) AS n, root FROM s LEFT JOIN u ON u.sh = s.sh LEFT JOIN root ON root.id = u.id)
        SELECT doc_id, n AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY root) END AS component_id,
          doc_id IS NOT DISTINCT FROM CASE WHEN n = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY root) END AS kept
        FROM m""",
    "op13_filter_audit": r"""
        WITH d AS (
          SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
            regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
            min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
          FROM documents),
        f AS (
          SELECT doc_id, part,
            CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
            || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
            || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END
            || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
            || CASE WHEN first_id IS NOT NULL AND (doc_id IS NULL OR doc_id > first_id) THEN 'E' ELSE '' END AS fails
          FROM d),
        l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT f.*, coalesce(good, false) AS good, coalesce(l.toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)),
        letter(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
        o AS (
          SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
          FROM letter a, letter b, letter c, letter d, letter e
          WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        s AS (
          SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS own, filter_order[1:step - 1] AS earlier
          FROM o, range(1, 6) r(step)),
        x AS (
          SELECT part, filter_order, step, own, good, toxic, fails = own AS alone, contains(fails, own) AS fail,
            earlier <> '' AND regexp_matches(fails, '[' || earlier || '_]') AS gone
          FROM m, s),
        t AS (
          SELECT part, filter_order, step, own,
            count(*) FILTER (NOT gone AND NOT fail) AS kept, count(*) FILTER (fail AND NOT gone) AS removed,
            count(*) FILTER (fail AND gone) AS redundant, count(*) FILTER (alone) AS unique_fails,
            count(*) FILTER (fail AND NOT gone AND good) AS good_lost, count(*) FILTER (fail AND NOT gone AND toxic) AS toxic_lost
          FROM x GROUP BY ALL)
        SELECT * EXCLUDE (own), CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM t""",
}
