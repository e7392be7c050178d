"""One query for each numbered operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import compression, importance, jpeg, line_runs, merkle, packing, personal_data, pieces, simhash, suffix_array, suffix_trees, tiling, url_cascade
from quillspark.llm.columns import ascii_lower

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
RULES = [
    url_cascade.Rule("org", "/", "allow"),
    url_cascade.Rule("example.org", "/es/", "block"),
    url_cascade.Rule("example.org", "/en/1", "block"),
    url_cascade.Rule("com", "/fr/", "allow"),
    url_cascade.Rule("com", "/de/", "block"),
]
#: A host is on the block list if one of its labels is one of these (fixed values).
LISTED_LABELS = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED = r"(^|\.)(" + "|".join(LISTED_LABELS) + r")(\.|$)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_cascade.judge_urls(pages, RULES, url_cascade.hosts_of(pages).filter(F.col("key").rlike(LISTED)))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside what 400 bytes remove, what repeats of 256 bytes cover: a passage of 50 words is often shorter than 400."""
    return suffix_array.remove_repeats(_table(spark, sf_dir, "documents"), shared=256).drop("most_places")


def op4_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return compression.score(docs, compression.train_on(docs, _table(spark, sf_dir, "labels")))


def op5_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), TOKENIZER, with_ids=False).drop("ids")


def op7_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests, and the full-resolution tensor (height, width, 3) as ``rgb``."""
    return jpeg.read_media(jpeg.store_texts(_table(spark, sf_dir, "documents")))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find_personal_data(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(personal_data.BASE))
    counts = [F.size(personal_data.of_kind(F.col("spans"), k)).cast("bigint").alias(f"n_{kind}") for k, kind in enumerate(personal_data.BASE)]
    n_spans = F.size("spans").cast("bigint")
    return found.select(
        "doc_id", *counts, F.sha2(personal_data.named(base), 256).alias("base_sha256"), personal_data.named(F.col("spans")).alias("spans"),
        n_spans.alias("n_spans"), (n_spans - F.size(base)).alias("n_added"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    thinned = line_runs.dedup_lines(_table(spark, sf_dir, "documents"))
    return thinned.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op10_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_trees.remove_repeated_words(_table(spark, sf_dir, "documents"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = pieces.decode_ids(pieces.encode_texts(_table(spark, sf_dir, "documents"), PIECES), PIECES)
    spelled = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(spelled, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = [ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in merkle.FIELDS]
    rows = docs.select("doc_id", "source", merkle.leaf(*map(F.col, merkle.FIELDS)).alias("leaf"), F.when(tampered, merkle.leaf(*changed)).alias("tampered"))
    fold = merkle.folded(F.coalesce("tampered", "leaf"), F.col("steps"))
    proven = merkle.manifest(rows).select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("steps")), 256).alias("proof_sha256"), fold.alias("folded_root"))
    return proven.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (op1_url_cascade, op2_simhash, op3_suffix_array, op4_compression, op5_tiling, op6_packing, op7_jpeg, op8_personal_data, op9_line_dedup, op10_suffix_trees, op11_sentencepiece, op12_merkle, op13_importance)
    return {f.__name__: f for f in operators}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_STRIPPED = r"regexp_replace(ln, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"


def _crc32(byte_list: str) -> str:
    """SQL of the CRC-32 of a list of bytes, eight steps a byte."""
    step = "list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b))"
    return f"xor(list_reduce({byte_list}, lambda c, b: {step}, 4294967295), 4294967295)"


def _merkle_sql() -> str:
    """A text's leaf, both as it is and with its A-Z lower-cased; levels, and then proofs and folds, by recursion."""

    def leaf(text: str) -> str:
        spelled = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(spelled)})"

    digits = _crc32("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))")
    run = "string_agg(digest, '' ORDER BY place) OVER (r ROWS BETWEEN {})"
    return f"""
        WITH RECURSIVE d AS (SELECT doc_id, source, {leaf("text")} AS leaf, {leaf(_LOWER.format("text"))} AS lowered FROM documents),
        s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) AS n FROM d GROUP BY source),
        l AS (SELECT doc_id, leaf, lowered, tree, n, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
        b AS (SELECT 0 AS level, tree, place, n, leaf AS digest FROM l
            UNION ALL SELECT level + 1, tree, place // 16, CAST(ceil(n / 16) AS BIGINT), sha256(string_agg(digest, '' ORDER BY place)) FROM b WHERE n > 1 GROUP BY level, tree, place // 16, n),
        u AS (SELECT tree, digest AS subroot FROM b WHERE n = 1),
        t AS (SELECT 0 AS level, tree AS place, (SELECT count(*) FROM s) AS n, subroot AS digest FROM u
            UNION ALL SELECT level + 1, place // 16, CAST(ceil(n / 16) AS BIGINT), sha256(string_agg(digest, '' ORDER BY place)) FROM t WHERE n > 1 GROUP BY level, place // 16, n),
        v AS (SELECT level, tree, place, n, digest, false AS top FROM b UNION ALL SELECT level, 0, place, n, digest, true FROM t),
        x AS (SELECT top, level, tree, place, coalesce({run.format("UNBOUNDED PRECEDING AND 1 PRECEDING")}, '') AS before, coalesce({run.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")}, '') AS after
            FROM v WHERE n > 1 WINDOW r AS (PARTITION BY top, level, tree, place // 16 ORDER BY place)),
        p AS (SELECT doc_id, tree, false AS top, place, 0 AS level, '' AS proof, CASE WHEN {digits} % 5 = 0 THEN lowered ELSE leaf END AS folded, n FROM l
            UNION ALL SELECT p.doc_id, p.tree, p.top OR p.n = 1, CASE WHEN p.n = 1 THEN p.tree ELSE p.place // 16 END, CASE WHEN p.n = 1 THEN 0 ELSE p.level + 1 END,
                CASE WHEN p.n = 1 THEN proof ELSE proof || before || after END, CASE WHEN p.n = 1 THEN folded ELSE sha256(before || folded || after) END,
                CASE WHEN p.n = 1 THEN (SELECT count(*) FROM s) ELSE CAST(ceil(p.n / 16) AS BIGINT) END
            FROM p LEFT JOIN x ON p.top = x.top AND p.level = x.level AND x.tree = CASE WHEN p.top THEN 0 ELSE p.tree END AND p.place = x.place WHERE NOT (p.top AND p.n = 1))
        SELECT l.doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = digest AS verified
        FROM l JOIN u USING (tree) JOIN (SELECT digest FROM t WHERE n = 1) ON true JOIN p ON p.doc_id = l.doc_id AND p.top AND p.n = 1"""


def _importance_sql() -> str:
    words = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words"
    feature_bytes = "list_transform(range(strlen(feature)), lambda i: CAST('0x' || substring(hex(encode(feature)), 2 * i + 1, 2) AS BIGINT))"
    return f"""
        WITH w AS (SELECT 'd' AS side, doc_id, {words} FROM documents UNION ALL SELECT 'b', item_id, {words} FROM benchmark),
        f AS (SELECT side, doc_id, unnest(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS feature FROM w),
        k AS (SELECT feature, {_crc32(feature_bytes)} % 10000 AS bucket FROM (SELECT DISTINCT feature FROM f)),
        e AS (SELECT side, doc_id, bucket FROM f JOIN k USING (feature)),
        c AS (SELECT bucket, count(*) FILTER (WHERE side = 'd') AS s, count(*) FILTER (WHERE side = 'b') AS t FROM e GROUP BY bucket),
        a AS (SELECT CAST(sum(s) AS DOUBLE) AS s_all, CAST(sum(t) AS DOUBLE) AS t_all FROM c),
        g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (s_all + 10000) / ((s + 1.0::DOUBLE) * (t_all + 10000)))) AS BIGINT) AS gain FROM c, a),
        m AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS total FROM e JOIN g USING (bucket) WHERE side = 'd' GROUP BY doc_id),
        d AS (SELECT w.doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, CASE WHEN n_features > 0 THEN (total - ((total % n_features) + n_features) % n_features) // n_features ELSE 0 END AS weight,
            CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('7:' || w.doc_id)[:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise FROM w LEFT JOIN m USING (doc_id) WHERE side = 'd'),
        r AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS place, count(*) OVER () AS n FROM d WHERE n_words >= 20)
        SELECT d.doc_id, n_features, weight, weight + noise AS score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM d LEFT JOIN r USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    fits = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
    ordered = sorted(RULES, key=lambda r: -len(r.text))
    rule = "CASE " + " ".join(f"WHEN {fits.format(r.host, r.path)} THEN '{r.text}'" for r in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits.format(r.host, r.path)} THEN '{r.verdict}'" for r in ordered)
    verdict += f" WHEN regexp_matches(host, '{LISTED}') THEN 'block' ELSE 'allow' END"
    return {
        "op1_url_cascade": f"""
            WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
            b AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a)
            SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict FROM b""",
        "op9_line_dedup": f"""
            WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS ln,
                       generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
            k AS (SELECT doc_id, ln, pos, {_LOWER.format(_STRIPPED)} AS key FROM l),
            r AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
            m AS (SELECT k.doc_id, k.ln, k.pos, r.key IS NOT NULL AND k.doc_id <> r.owner AS gone FROM k LEFT JOIN r ON k.key = r.key)
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
                   sha256(coalesce(string_agg(ln, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
            FROM m GROUP BY doc_id""",
        # a text's bytes as hexadecimal digits, two for each; a string of n bytes starts at each place
        "op3_suffix_array": """
            WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
            b AS (SELECT doc_id, x, unnest(range(0, length(x), 512)) AS base FROM d),
            y AS (SELECT doc_id, base // 2 AS base, least(512, length(x) - base) // 2 AS n, x[base + 1 : base + 1312] AS x FROM b),
            p AS (SELECT doc_id, base, x, unnest(range(n)) AS k FROM y),
            w AS (SELECT doc_id, base + k AS pos, x[2 * k + 1 : 2 * k + 2] AS byte,
                  CASE WHEN 2 * k + 800 <= length(x) THEN md5(x[2 * k + 1 : 2 * k + 800]) END AS long,
                  CASE WHEN 2 * k + 512 <= length(x) THEN md5(x[2 * k + 1 : 2 * k + 512]) END AS short FROM p),
            s AS (SELECT doc_id, pos, byte, long IS NOT NULL AND count(*) OVER (PARTITION BY long) > 1 AS gone,
                  short IS NOT NULL AND count(*) OVER (PARTITION BY short) > 1 AS shared FROM w),
            c AS (SELECT doc_id, pos, byte, max(gone) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) AS gone,
                  max(shared) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 255 PRECEDING AND CURRENT ROW) AS shared FROM s),
            r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER o, false) AS starts, pos - sum(shared::INT) OVER o AS run FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
            l AS (SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, run, count(*) AS n FROM r WHERE shared GROUP BY ALL) GROUP BY doc_id),
            g AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE starts) AS n_spans, count(*) FILTER (WHERE shared) AS n_shared,
                  string_agg(byte, '' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM r GROUP BY doc_id)
            SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256,
                   coalesce(n_shared, 0) AS n_shared, coalesce(longest, 0) AS longest_shared
            FROM d LEFT JOIN g USING (doc_id) LEFT JOIN l USING (doc_id)""",
        "op10_suffix_trees": r"""
            WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
            p AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS pos FROM d),
            w AS (SELECT doc_id, pos, words[pos] AS word, CASE WHEN pos + 19 <= len(words) THEN array_to_string(words[pos : pos + 19], ' ') END AS passage FROM p),
            s AS (SELECT doc_id, pos, word, passage IS NOT NULL AND row_number() OVER (PARTITION BY passage ORDER BY doc_id, pos) > 1 AS again FROM w),
            c AS (SELECT doc_id, pos, word, max(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM s),
            g AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id)
            SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
            FROM d LEFT JOIN g USING (doc_id)""".replace("\\\\", "\\"),
        "op12_merkle": _merkle_sql(),
        "op13_importance": _importance_sql(),
    }
