"""The queries of this subpackage, with the production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, licences, lm, near_dedup, packing, pii, prefix_trie, quality, ranking, token_counts, token_files, toxicity
from .common import LOWER, UPPER, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_shards(token_files.write_shards(table(spark, sf_dir, "documents"), tokenizer_path()))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op13_grouped_ranking_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.sale_line_ranks(table(spark, sf_dir, "sale_lines"))


def base2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op2_personal_data: the fixed patterns' spans."""
    return op2_personal_data(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def base4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op4_lm_scores: exact counts and the score from them."""
    return op4_lm_scores(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def base10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op10_quality_rules: the counts and the base rule."""
    return op10_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_personal_data": op2_personal_data,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_lm_scores": op4_lm_scores,
    "op5_language": op5_language,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_licence_scan": op7_licence_scan,
    "op8_token_files": op8_token_files,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_quality_rules": op10_quality_rules,
    "op11_conversation_prefix_trie": op11_conversation_prefix_trie,
    "op12_token_counts": op12_token_counts,
    "op13_grouped_ranking_ties": op13_grouped_ranking_ties,
    "base2_personal_data": base2_personal_data,
    "base4_lm_scores": base4_lm_scores,
    "base10_quality_rules": base10_quality_rules,
}

_SPACES = r"[\x20\x09-\x0D]+"

_NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_SPACES}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i]||' '||w[i+1])) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
u AS (SELECT doc_id, unnest(s) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM l JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, t.b FROM r JOIN both_ways t ON t.a = r.y)
SELECT doc_id, n AS n_shingles, min(y) AS component_id, doc_id = min(y) AS kept FROM n JOIN r ON r.x = n.doc_id GROUP BY doc_id, n
"""


def _seed(mask: str) -> str:
    """The words at the 1s of a mask, null where the window reaches beyond the text."""
    return f"CASE WHEN w{len(mask) - 1} IS NOT NULL THEN concat_ws(' ', " + ", ".join(f"w{k}" for k, bit in enumerate(mask) if bit == "1") + ") END"


def _leaks() -> str:
    words = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    # Fixed values of the rule: each mask with the numbers of words of the items that it is for, 14 being 14 and more.
    for_words = {"11011001": range(8, 15), "110100101": range(8, 15), "1010011011": range(8, 15), "111": (3, *range(8, 14)), "11011": range(8, 14)} | {"1" * n: (n,) for n in (7, 6, 5, 4, 2, 1)}
    masks, widest = list(for_words), max(map(len, for_words))
    fits = " OR ".join(f"(b.mask = {k} AND least(b.n, 14) IN ({', '.join(map(str, lengths))}))" for k, lengths in enumerate(for_words.values()))
    ahead = ", ".join(f"lead(w, {k}) OVER o AS w{k}" for k in range(1, widest))
    seeds = " UNION ALL ".join(f"SELECT id, i, n, {k} AS mask, {_seed(m)} AS seed FROM {{t}}_ahead" for k, m in enumerate(masks))
    part = (
        "{t} AS (SELECT id, unnest(w) AS w, generate_subscripts(w, 1) AS i, len(w) AS n FROM (SELECT {key} AS id, " + words + " AS w FROM {table}) z), "
        "{t}_ahead AS (SELECT id, i, n, w AS w0, " + ahead + " FROM {t} WINDOW o AS (PARTITION BY id ORDER BY i)), {t}_seeds AS (" + seeds + ")"
    )
    fill = lambda **x: part.replace("{t}", x["t"]).replace("{key}", x["key"]).replace("{table}", x["table"])
    return (
        "WITH "
        + fill(t="d", key="doc_id", table="documents")
        + ", "
        + fill(t="b", key="item_id", table="benchmark")
        + f", item_seeds AS (SELECT * FROM b_seeds b WHERE {fits}), "
        "hits AS (SELECT DISTINCT d.id AS doc_id, b.id AS item_id, d.i - b.i AS shift, b.n FROM d_seeds d JOIN item_seeds b ON d.mask = b.mask AND d.seed = b.seed), "
        "lined AS (SELECT h.doc_id, h.item_id, h.shift, b.i AS j, h.n, CASE WHEN d.w = b.w THEN 1 ELSE 0 END AS same FROM hits h JOIN b ON b.id = h.item_id LEFT JOIN d ON d.id = h.doc_id AND d.i = h.shift + b.i), "
        "sums AS (SELECT doc_id, item_id, j, least(13, n) AS length, sum(same) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS k FROM lined), "
        "found AS (SELECT doc_id, item_id, max(k) AS k FROM sums WHERE j >= length AND k * 100 >= length * CASE WHEN length < 8 THEN 100 ELSE 75 END GROUP BY 1, 2) "
        "SELECT doc_id, count(*) AS n_items, min(item_id) AS first_item, max(k)::BIGINT AS n_equal FROM found GROUP BY 1"
    )


#: crc32 of the ASCII string {s}, byte by byte and bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({s}, ''), lambda ch: ascii(ch)::BIGINT)), lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, bit: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
_WORDS = f"list_filter(string_split_regex({{text}}, '{_SPACES}'), lambda x: x <> '')"
_BASE_LM = (
    f"WITH w AS (SELECT doc_id, {_CRC.format(s='doc_id::VARCHAR')} % 5 = 1 AS held_out, list_append({_WORDS.format(text=f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")}, chr(10)) AS w FROM documents), "
    "t AS (SELECT doc_id, held_out, unnest(w) AS w FROM w), c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1), n AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c) "
    "SELECT doc_id, held_out, count(*) AS n_tokens, count(c.c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c.c, 0) + 0.5) / (n + 0.5 * (v + 1)))), 4) AS base_score FROM t LEFT JOIN c USING (w) CROSS JOIN n GROUP BY 1, 2"
)
_BASE_QUALITY = (
    f"WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format(text="coalesce(text, '')")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents), "
    "g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w), h AS (SELECT doc_id, i, w[i]||' '||w[i+1]||' '||w[i+2] AS g FROM g), "
    "r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM h), p AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM r WHERE n > 1), k AS (SELECT doc_id, count(*) AS n FROM p GROUP BY 1), "
    "z AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(k.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN k USING (doc_id)) "
    "SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM z"
)
#: kind, pattern, and what a match {x} must pass; fixed values of the contract.
_DIGITS = "regexp_replace({x}, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda d, k: CASE WHEN k % 2 = 1 THEN d::INTEGER ELSE d::INTEGER * 2 - 9 * (d::INTEGER > 4)::INTEGER END)) % 10 = 0"
_KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split({x}, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(nullif(ltrim(p, '0'), '') AS INTEGER), 0) > 255)) = 0"),
    ("card", r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
]


def _base_spans() -> str:
    """Starts from the lengths of what stands between matches."""
    spans = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS kind, '{kind}' AS name, unnest(list_transform(m, lambda x, j: {{'x': x, 'start': list_sum(list_transform(p[:j], lambda y: length(y))) + coalesce(list_sum(list_transform(m[:j - 1], lambda y: length(y))), 0)}})) AS s "
        f"FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS p FROM t) q"
        for k, (kind, pattern, _) in enumerate(_KINDS)
    )
    passed = " OR ".join(f"(kind = {k} AND {test.format(x='s.x')})" for k, (_, _, test) in enumerate(_KINDS))
    return (
        f"WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), a AS ({spans}), b AS (SELECT doc_id, kind, name, s.start AS st, s.start + length(s.x) AS en FROM a WHERE {passed}), "
        "c AS (SELECT doc_id, " + ", ".join(f"count(*) FILTER (kind = {k}) AS n_{kind}" for k, (kind, _, _) in enumerate(_KINDS)) + ", string_agg(name||':'||st::BIGINT||':'||en::BIGINT, ',' ORDER BY kind, st) AS listed FROM b GROUP BY 1) "
        "SELECT doc_id, " + ", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, _, _ in _KINDS) + ", sha256(coalesce(listed, '')) AS base_sha256 FROM t LEFT JOIN c USING (doc_id)"
    )


_PREFIX_TRIE = (
    "WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL), "
    "d AS (SELECT conv_id, turn, sha256(length(role)||':'||role||text)[:32] AS d, length(text)::BIGINT AS c FROM t), "
    f"o AS (SELECT conv_id, list({{'d': d, 'c': c}} ORDER BY turn NULLS FIRST, d) AS t, {_CRC.format(s='conv_id::VARCHAR')} % 6 AS h FROM d GROUP BY conv_id), "
    "r AS (SELECT o.conv_id, list_concat(coalesce(b.t[1:o.h], []), o.t[o.h + 1:]) AS p FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 100), "
    "u AS (SELECT conv_id, p, unnest(range(len(p) + 1)) AS depth FROM r), "
    "x AS (SELECT conv_id, depth, len(p) = depth AS ends, md5(array_to_string(list_transform(p[1:depth], lambda x: x.d), ',')) AS k, md5(array_to_string(list_transform(p[1:depth - 1], lambda x: x.d), ',')) AS up, CASE WHEN depth > 0 THEN p[depth].c ELSE 0 END AS c FROM u), "
    "n AS (SELECT k, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(c) AS c, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM x GROUP BY k, depth), "
    "kids AS (SELECT up, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL), "
    "m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids ON kids.up = n.k AND kids.depth = n.depth), "
    # A node's ancestors are the beginnings of its smallest member.
    "s AS (SELECT x.k, x.depth, count(*) FILTER (m.n_children = 0) AS n_leaves, sum((m.n_convs - 1) * m.c)::BIGINT AS saved_tokens FROM m JOIN x ON x.conv_id = m.conv_id AND x.depth <= m.depth GROUP BY ALL) "
    "SELECT m.conv_id, m.depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, m.ends_sha256 FROM m JOIN s ON s.k = m.k AND s.depth = m.depth LEFT JOIN n p ON p.k = m.up AND p.depth = m.depth - 1"
)
_ORDER = "tens DESC NULLS LAST, percent NULLS LAST"
_TIED_RANKS = (
    f"WITH h AS (SELECT sale_id, {_CRC.format(s='sale_id::VARCHAR')} % 5 = 0 AS alone FROM (SELECT DISTINCT sale_id FROM sale_lines WHERE sale_id IS NOT NULL) s), "
    "l AS (SELECT CASE WHEN alone THEN -1 ELSE vendor_id END AS vendor_id, CASE WHEN alone THEN -1 ELSE coalesce(item_id % 5, -1) END AS part, CASE WHEN alone THEN -1 ELSE coalesce(100 * year(shipped_at) + month(shipped_at), -1) END AS month, "
    "sale_id, line_no::BIGINT AS line_no, quantity::BIGINT AS quantity, floor(quantity / 10) AS tens, floor(100 * discount + 0.5)::BIGINT AS percent, floor(100 * amount + 0.5)::BIGINT AS amount_cents FROM sale_lines LEFT JOIN h USING (sale_id)), "
    f"r AS (SELECT *, row_number() OVER (PARTITION BY vendor_id, part, month ORDER BY {_ORDER}, sale_id NULLS LAST, line_no NULLS LAST, quantity NULLS LAST, amount_cents NULLS LAST) AS pos, count(*) OVER (PARTITION BY vendor_id, part, month, tens, percent) AS tied, "
    f"rank() OVER (PARTITION BY vendor_id, part, month ORDER BY {_ORDER}) AS rank, dense_rank() OVER (PARTITION BY vendor_id, part, month ORDER BY {_ORDER}) AS dense_rank FROM l) "
    "SELECT vendor_id, part, month, pos, pos AS place, sale_id, line_no, quantity, percent, amount_cents, tied, rank, dense_rank FROM r WHERE pos <= 2"
)

ORACLE_SQL: dict[str, str] = {
    "op3_minhash_near_dedup": _NEAR_DUPLICATES,
    "op9_benchmark_decontamination": _leaks(),
    "op11_conversation_prefix_trie": _PREFIX_TRIE,
    "op13_grouped_ranking_ties": _TIED_RANKS,
    "base2_personal_data": _base_spans(),
    "base4_lm_scores": _BASE_LM,
    "base10_quality_rules": _BASE_QUALITY,
}
