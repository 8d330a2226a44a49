"""The operators over the driver's tables, one registered query each."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.llm import decontaminate, exact_dedup, fill_in_middle, merkle, near_dedup, packing, sharding, substring_trees, suffix_array, suffix_tree_lm, topk, toxicity, warc
from billweave.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            configure(spark)
            return fn(spark, lambda table: spark.read.parquet(f"{folder}/{table}.parquet"))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query(
    "op1_topk",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS ints FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.ints, c.ints), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.ints) = len(c.ints) WHERE q.vec_id % 50 = 0),
    r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
)
def op1_topk(spark, table):
    """The five best products for every fiftieth vector, over all vectors."""
    return topk.top_k(table("embeddings"), k=5, query_every=50)


@query(
    "op3_warc",
    """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    o AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS original FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN original <> page_id THEN original END AS refers_to FROM o""",
)
def op3_warc(spark, table):
    """Pages written as deduplicated archives and read back."""
    return warc.archived(table("pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op4_decontaminate",
    rf"""WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
    p AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n, unnest(list_transform(range(1, len(ws) - least(13, len(ws)) + 2), lambda i: array_to_string(ws[i:i + least(13, len(ws)) - 1], ' '))) AS k FROM b WHERE len(ws) > 0),
    z AS (SELECT DISTINCT n FROM p),
    s AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS i, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS k FROM w CROSS JOIN z WHERE len(ws) >= n),
    f AS (SELECT doc_id, i, n, item_id FROM s JOIN p USING (n, k)),
    h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM f) GROUP BY 1),
    t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM f) GROUP BY 1)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(ws) AS contaminated FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
)
def op4_decontaminate(spark, table):
    """Every document against every benchmark item."""
    found = decontaminate.contamination_report(table("documents"), table("benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op10_shards")
def op10_shards(spark, table):
    """All documents over eight shards, and over nine."""
    return sharding.assign_shards(table("documents"), shards=8)


@query("op6_packing")
def op6_packing(spark, table):
    """All documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    return packing.pack_documents(table("documents"), public_tokenizers.path(packing.TOKENIZER), max_tokens=4096)


@query("op9_toxicity")
def op9_toxicity(spark, table):
    """Every document's toxicity, learned from two thirds of the labels."""
    found = toxicity.toxicity_report(table("documents"), table("labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


@query("op8_suffix_tree_lm")
def op8_suffix_tree_lm(spark, table):
    """log10 probabilities of all texts, learned from six sevenths of them."""
    return suffix_tree_lm.score_documents(table("documents"))


@query("op7_suffix_array")
def op7_suffix_array(spark, table):
    """Bytes left of every document without strings of 400 bytes that start twice."""
    return suffix_array.removal_report(table("documents"), length=400)


@query(
    "op2_substring_trees",
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' '))) AS k FROM w WHERE len(ws) >= 13),
    m AS (SELECT k, min(doc_id) AS first FROM s GROUP BY k),
    h AS (SELECT DISTINCT doc_id, i + j AS pos FROM s JOIN m USING (k) CROSS JOIN range(13) t(j) WHERE first < doc_id),
    u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
    t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM u ANTI JOIN h USING (doc_id, pos) GROUP BY 1)
    SELECT doc_id, len(ws)::BIGINT AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN t USING (doc_id)""",
)
def op2_substring_trees(spark, table):
    """Words left of every document without windows of 13 words that an earlier one has."""
    return substring_trees.removal_report(table("documents"), window=13)


@query(
    "op5_near_dedup",
    rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
    g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS k FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM g a JOIN g b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
    r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
    o AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM o LEFT JOIN n USING (doc_id)""",
)
def op5_near_dedup(spark, table):
    """Components of documents with a shingle similarity of 0.75 or more."""
    return near_dedup.component_report(table("documents"))


_FIELD = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


# the checksum of a text of plain characters, by its table; ``k`` is that table
_CRC_TABLE = "(SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS k)"
_CRC = """xor(4294967295, list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
      lambda c, b: xor(k[(xor(c, b) & 255) + 1], c >> 8)))"""
# a tree is one list a level; a parent is the hash of a pair, the last one's of a single node where the count is odd
_CLIMB = """SELECT {key}, level + 1, list_transform(range(1, (len(nodes) + 1) // 2 + 1), lambda i: sha256(nodes[2 * i - 1] || coalesce(nodes[2 * i], '')))
      FROM {tree} WHERE len(nodes) > 1"""
# one step of a proof: the side the sibling stands on and the sibling
_STEP = "CASE WHEN (({at} - 1) >> level) % 2 = 1 THEN 'L' || nodes[(({at} - 1) >> level)] ELSE 'R' || coalesce(nodes[(({at} - 1) >> level) + 2], '') END"


@query(
    "op11_merkle",
    f"""WITH RECURSIVE l AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf_sql("n_chars")} AS leaf,
        {_CRC} % 7 = 0 AS hit, {_leaf_sql("(n_chars + 1)")} AS changed FROM documents, {_CRC_TABLE}),
    p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id) AS pos FROM l),
    t(tree, level, nodes) AS (SELECT tree, 0, list(leaf ORDER BY pos) FROM p GROUP BY tree UNION ALL {_CLIMB.format(key="tree", tree="t")}),
    s AS (SELECT tree, nodes[1] AS subroot, row_number() OVER (ORDER BY encode(tree)) AS place FROM t WHERE len(nodes) = 1),
    f(one, level, nodes) AS (SELECT 1, 0, list(subroot ORDER BY place) FROM s UNION ALL {_CLIMB.format(key="one", tree="f")}),
    r AS (SELECT nodes[1] AS root FROM f WHERE len(nodes) = 1),
    a AS (SELECT doc_id, list({_STEP.format(at="pos")} ORDER BY level) AS steps FROM p JOIN t USING (tree) WHERE len(nodes) > 1 GROUP BY 1),
    b AS (SELECT tree, list({_STEP.format(at="place")} ORDER BY level) AS steps FROM s, f WHERE len(nodes) > 1 GROUP BY 1),
    c AS (SELECT p.doc_id, leaf, subroot, root, coalesce(a.steps, []) || coalesce(b.steps, []) AS steps, CASE WHEN hit THEN changed ELSE leaf END AS start
      FROM p JOIN s USING (tree) CROSS JOIN r LEFT JOIN a USING (doc_id) LEFT JOIN b USING (tree)),
    d AS (SELECT *, list_reduce([start] || steps, lambda low, step: CASE WHEN step[1] = 'L' THEN sha256(step[2:] || low) ELSE sha256(low || step[2:]) END) AS folded_root FROM c)
    SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda x: x[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM d""",
)
def op11_merkle(spark, table):
    """The manifest of all documents by language, every seventh one (by checksum) claimed one character longer."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    said = F.when(tampered, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))
    rows = merkle.manifest(table("documents"), claimed={"n_chars": said})
    proof = F.sha2(merkle.proof_text(F.col("proof")), 256)
    return rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


@query(
    "op12_fill_in_middle",
    """WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
    g AS (SELECT *, list_transform(range(4), lambda i: ('0x' || s[8 * i + 1:8 * i + 8])::BIGINT) AS h FROM h),
    c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
      CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
    o AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1, n - b) AS s3 FROM c)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s3 || '<M>' || m ELSE '<S>' || s3 || '<P>' || p || '<M>' || m END) AS output_sha256,
      sha256(t) AS restored_sha256 FROM o""",
)
def op12_fill_in_middle(spark, table):
    """All documents cut in three and arranged, and put together again."""
    rows = fill_in_middle.hashes(table("documents"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


@query(
    "op13_exact_dedup",
    """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, text_sha256
    FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents) WINDOW same AS (PARTITION BY text_sha256)""",
)
def op13_exact_dedup(spark, table):
    """Groups of equal texts; every second document, by checksum, is the history the others are looked up in."""
    return exact_dedup.exact_groups(table("documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
