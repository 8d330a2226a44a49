"""Queries for reference lists, names and matching."""

from pyspark.sql import functions as F

from billweave import fixed
from billweave.functions import names
from billweave.operators import evaluate, reconcile, reference
from billweave.plans.intake import by_case
from billweave.plans.registry import ORACLES, query
from billweave.session import cut_lineage
from billweave.sources import remote
from billweave.sources.remote import wanted_records


# --- reference snapshots -------------------------------------------------------
def old_snapshot(t):
    """All customers: the market segment is the company, the nation picks the kind of record."""
    kind = F.pmod("c_nationkey", F.lit(3))
    return t.customer.select(
        F.col("c_mktsegment").alias("realm_id"),
        by_case(kind, F.lit("vendor"), F.lit("account"), F.lit("item")).alias("entity_kind"),
        F.col("c_custkey").cast("string").alias("entity_id"),
        F.when(kind == 1, F.concat(F.lit("Costs: "), "c_name")).otherwise(F.col("c_name")).alias("name"),
        (F.col("c_acctbal") > 0).alias("active"),
        F.when(kind == 1, by_case(F.pmod("c_custkey", F.lit(4)), F.lit("Expense"), F.lit("Bank"), F.lit("Credit Card"), F.lit("Income"))).alias("account_type"),
        F.lit(None).cast("string").alias("account_sub_type"),
        F.lit("2024-01-01").alias("synced_at"),
    )


def received(t):
    """A later pull of all companies but one: overdrawn customers vanished, some were renamed."""
    rows = old_snapshot(t).join(t.customer.select(F.col("c_custkey").cast("string").alias("entity_id"), "c_acctbal", "c_nationkey"), "entity_id")
    return (
        rows.filter((F.col("realm_id") != "FURNITURE") & (F.col("c_acctbal") >= -500))
        .withColumn("name", F.when(F.col("c_nationkey") < 5, F.concat(F.lit("New "), "name")).otherwise(F.col("name")))
        .withColumn("active", F.lit(True))
        .drop("c_acctbal", "c_nationkey", "synced_at")
    )


_OLD_SQL = """old AS (SELECT c_mktsegment AS realm_id, ['vendor', 'account', 'item'][c_nationkey % 3 + 1] AS entity_kind, CAST(c_custkey AS VARCHAR) AS entity_id,
  CASE WHEN c_nationkey % 3 = 1 THEN 'Costs: ' ELSE '' END || c_name AS name, c_acctbal > 0 AS active,
  CASE WHEN c_nationkey % 3 = 1 THEN ['Expense', 'Bank', 'Credit Card', 'Income'][c_custkey % 4 + 1] END AS account_type, c_acctbal, c_nationkey FROM customer),
merged AS (SELECT realm_id, entity_kind, entity_id, CASE WHEN arrived AND c_nationkey < 5 THEN 'New ' || name ELSE name END AS name,
  CASE WHEN arrived THEN true WHEN realm_id = 'FURNITURE' THEN active ELSE false END AS active, account_type,
  CASE WHEN arrived THEN '2024-02-01' ELSE '2024-01-01' END AS synced_at
  FROM (SELECT *, realm_id <> 'FURNITURE' AND c_acctbal >= -500 AS arrived FROM old))"""


def merged(t):
    new = received(t)
    realms = old_snapshot(t).select("realm_id").filter(F.col("realm_id") != "FURNITURE").distinct()
    return reference.merge_snapshot(old_snapshot(t), new, realms, F.lit("2024-02-01"))


@query("ref_merge", f"WITH {_OLD_SQL} SELECT * FROM merged")
def ref_merge(t):
    """Received rows replace, vanished rows of a pulled company turn inactive, other companies stay."""
    return merged(t).drop("account_sub_type")


@query(
    "ref_sync_counts",
    f"""WITH {_OLD_SQL} SELECT realm_id, count(*) FILTER (entity_kind = 'vendor') AS vendors, count(*) FILTER (account_type = 'Expense') AS expense_accounts,
    count(*) FILTER (account_type IN ('Bank', 'Credit Card')) AS payment_accounts, count(*) FILTER (entity_kind = 'item') AS items
    FROM old WHERE realm_id <> 'FURNITURE' AND c_acctbal >= -500 GROUP BY 1""",
)
def ref_sync_counts(t):
    return reference.sync_counts(received(t))


@query(
    "ref_lists",
    f"""WITH {_OLD_SQL} SELECT realm_id, CASE entity_kind WHEN 'vendor' THEN 'vendors' WHEN 'item' THEN 'items' ELSE CASE WHEN account_type = 'Expense' THEN 'expense_accounts'
      ELSE 'payment_accounts' END END AS list_name, entity_id, name, active FROM merged WHERE account_type IS DISTINCT FROM 'Income'""",
)
def ref_lists(t):
    return reference.read_lists(merged(t)).select("realm_id", "list_name", "entity_id", "name", "active")


@query(
    "ref_drop_realm",
    f"WITH {_OLD_SQL} SELECT realm_id, entity_id FROM old WHERE realm_id <> 'BUILDING'",
)
def ref_drop_realm(t):
    return reference.drop_realm(old_snapshot(t), "BUILDING").select("realm_id", "entity_id")


@query(
    "ref_lookup",
    f"""WITH {_OLD_SQL} SELECT o_orderkey, m.name AS vendor_name FROM orders o JOIN customer c ON o_custkey = c_custkey
    LEFT JOIN merged m ON m.entity_kind = 'vendor' AND m.entity_id = CAST(o_custkey AS VARCHAR)""",
)
def ref_lookup(t):
    """Names by id, inactive records included."""
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.col("c_mktsegment").alias("realm_id"), F.col("o_custkey").cast("string").alias("vendor_id")
    )
    return reference.resolve(rows, merged(t), "vendor", "vendor_id", "vendor_name").select("o_orderkey", "vendor_name")


@query(
    "option_list",
    f"""WITH {_OLD_SQL} SELECT realm_id, entity_id, active FROM merged m WHERE active OR EXISTS (SELECT 1 FROM orders WHERE o_orderpriority = '1-URGENT' AND CAST(o_custkey AS VARCHAR) = m.entity_id)""",
)
def option_list(t):
    """Active records, and inactive ones an urgent order still uses."""
    chosen = t.orders.filter(F.col("o_orderpriority") == "1-URGENT").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("realm_id"), F.col("o_custkey").cast("string").alias("entity_id")
    )
    return reference.option_list(merged(t), chosen).select("realm_id", "entity_id", "active")


@query(
    "account_leaf",
    """SELECT p_partkey, p_type || ':' || p_brand || ': ' || p_name || ' ' AS path, CASE WHEN p_size < 5 THEN p_type || ':' ELSE p_name END AS leaf FROM part""",
)
def account_leaf(t):
    """Last segment of an account path, the whole path when it is blank."""
    path = F.concat_ws(":", "p_type", "p_brand", F.concat(F.lit(" "), "p_name", F.lit(" ")))
    return t.part.select(
        "p_partkey",
        path.alias("path"),
        reference.account_leaf(F.when(F.col("p_size") < 5, F.concat("p_type", F.lit(":"))).otherwise(path)).alias("leaf"),
    )


_RECORD = "Id string, DisplayName string, CompanyName string, Name string, FullyQualifiedName string, AccountType string, AccountSubType string, Active boolean"


@query(
    "remote_pages",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS i FROM customer)
    SELECT c_mktsegment AS realm_id, 'account' AS entity_kind, CAST(c_custkey AS VARCHAR) AS entity_id, CASE WHEN c_nationkey < 12 THEN 'All:' || c_name ELSE c_name END AS name,
      CASE WHEN c_nationkey % 2 = 0 THEN 'Bank' ELSE 'Expense' END AS account_type, c_acctbal > 0 AS active FROM n WHERE c_nationkey % 5 <> 4""",
)
def remote_pages(t):
    """Paged JSON of accounts, one record per page line: filtered, mapped, unusable records dropped."""
    nation = F.col("c_nationkey")
    record = F.to_json(
        F.struct(
            F.col("c_custkey").cast("string").alias("Id"),
            F.col("c_name").alias("Name"),
            F.when(nation < 12, F.concat(F.lit("All:"), "c_name")).alias("FullyQualifiedName"),
            F.when(F.pmod(nation, F.lit(5)) == 4, "Income").when(F.pmod(nation, F.lit(2)) == 0, "Bank").otherwise("Expense").alias("AccountType"),
            (F.col("c_acctbal") > 0).alias("Active"),
        )
    )
    rows = t.customer.select(F.col("c_mktsegment").alias("realm_id"), F.lit("Account").alias("entity"), F.from_json(record, _RECORD).alias("record"))
    return reference.map_records(wanted_records(rows)).select("realm_id", "entity_kind", "entity_id", "name", "account_type", "active")


def remote_lists(t):
    """Landed pages of three pulls, 1,000 records a page: customers as vendors, suppliers as accounts, parts as items.

    A left-over page stands one page behind each pull's last one.
    """

    def pull(rows, entity, key, **fields):
        record = F.from_json(F.to_json(F.struct(F.col(key).cast("string").alias("Id"), *[v.alias(k) for k, v in fields.items()])), _RECORD)
        numbered = rows.select(F.floor(F.col(key) / 1000).cast("int").alias("page_no"), record.alias("record"))
        left_over = F.from_json(F.lit('{"Id": "old", "Name": "left over", "DisplayName": "left over", "AccountType": "Bank"}'), _RECORD)
        behind = numbered.agg((F.max("page_no") + 2).alias("page_no")).select("page_no", left_over.alias("record"))
        paged = numbered.unionByName(behind).groupBy("page_no").agg(F.collect_list("record").alias("records"))
        return paged.select(F.lit("r1").alias("realm_id"), F.lit(entity).alias("entity"), "page_no", "records")

    vendors = pull(t.customer, "Vendor", "c_custkey", DisplayName=F.col("c_name"), Active=F.col("c_acctbal") > 0)
    accounts = pull(t.supplier, "Account", "s_suppkey", Name=F.col("s_name"), AccountType=F.when(F.col("s_nationkey") < 12, "Expense").otherwise("Income"))
    return vendors.unionByName(accounts).unionByName(pull(t.part, "Item", "p_partkey", Name=F.when(F.col("p_size") > 3, F.col("p_name"))))


@query(
    "remote_union",
    """WITH n AS (SELECT 'vendor' AS entity_kind, count(*) % 1000 <> 0 AS complete FROM customer UNION ALL SELECT 'account', count(*) % 1000 <> 0 FROM supplier
      UNION ALL SELECT 'item', count(*) % 1000 <> 0 FROM part),
    r AS (SELECT 'vendor' AS entity_kind, CAST(c_custkey AS VARCHAR) AS entity_id, c_name AS name FROM customer WHERE c_acctbal > 0
      UNION ALL SELECT 'account', CAST(s_suppkey AS VARCHAR), s_name FROM supplier WHERE s_nationkey < 12
      UNION ALL SELECT 'item', CAST(p_partkey AS VARCHAR), p_name FROM part WHERE p_size > 3
      UNION ALL SELECT entity_kind, 'old', 'left over' FROM n WHERE NOT complete)
    SELECT 'r1' AS realm_id, entity_kind, entity_id, name, complete FROM r JOIN n USING (entity_kind)""",
)
def remote_union(t):
    """Records of all pages up to each pull's end, and whether that pull is complete."""
    pages = remote_lists(t)
    records = reference.map_records(remote.remote_records(pages)).select("realm_id", "entity_kind", "entity_id", "name")
    whole = remote.complete_pulls(pages).select("realm_id", F.lower("entity").alias("entity_kind"), F.lit(True).alias("complete"))
    return records.join(whole, ["realm_id", "entity_kind"], "left").withColumn("complete", F.coalesce("complete", F.lit(False)))


@query(
    "vision_class",
    """SELECT event_id, CASE WHEN event_type = 'view' AND value > 40 THEN 'vision' WHEN event_type IN ('click', 'signup', 'purchase') THEN 'vision-family' ELSE 'unknown' END AS vision FROM events""",
)
def vision_class(t):
    """Model ids built from events: declared image input, known families, unknown ones."""
    kind = F.col("event_type")
    user = F.col("user_id").cast("string")
    model = (
        F.when(kind == "click", F.concat(F.lit("openai/GPT-4o-"), user))
        .when(kind == "signup", F.lit("o3-mini"))
        .when(kind == "purchase", F.concat(F.lit("qwen2.5-vl-"), user))
        .otherwise(F.concat(F.lit("text-only-"), user))
    )
    inputs = F.when((kind == "view") & (F.col("value") > 40), F.array(F.lit("text"), F.lit("Image")))
    return t.events.select("event_id", reference.vision_class(model, inputs).alias("vision"))


@query(
    "model_catalogue",
    """SELECT 'm-' || event_type || '-' || user_id AS id, 'vision' AS vision, count(*) AS entries FROM events WHERE event_type <> 'error' GROUP BY 1""",
)
def model_catalogue(t):
    """Model listing entries as JSON; broken ones are skipped."""
    entry = F.concat(F.lit('{"id": "m-'), "event_type", F.lit("-"), F.col("user_id").cast("string"), F.lit('", "architecture": {"input_modalities": ["text", "image"]}, "x": '), "props", F.lit("}"))
    entries = t.events.select(F.when(F.col("event_type") == "error", "oops").otherwise(entry).alias("entry"))
    return reference.model_catalogue(entries).groupBy("id", "vision").agg(F.count("*").alias("entries"))


# --- names ---------------------------------------------------------------------
def company_name():
    form = by_case(F.pmod("p_size", F.lit(5)), F.lit(" LLC"), F.lit(", Inc."), F.lit(" & Co"), F.lit(""), F.lit(" Supply Company"))
    return F.concat(F.lit("Café-"), F.initcap("p_name"), F.lit(" "), F.col("p_brand"), form)


_NORM_SQL = """n AS (SELECT p_partkey, trim(regexp_replace(replace(lower(strip_accents('Café-' || p_name || ' ' || p_brand ||
  [' LLC', ', Inc.', ' & Co', '', ' Supply Company'][p_size % 5 + 1])), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS folded FROM part),
k AS (SELECT p_partkey, array_to_string(list_filter(string_split(folded, ' '), lambda w: w NOT IN ('llc', 'inc', 'co', 'company')), ' ') AS norm FROM n)"""


@query("norm_name", f"WITH {_NORM_SQL} SELECT p_partkey, norm FROM k")
def norm_name(t):
    """Comparable core of names with accents, punctuation and company forms."""
    return t.part.select("p_partkey", names.normal_form(company_name()).alias("norm"))


@query(
    "name_tokens",
    f"""WITH {_NORM_SQL}, w AS (SELECT p_partkey, unnest(string_split(norm || ' ' || norm, ' ')) AS word FROM k)
    SELECT p_partkey, word, count(*) AS copies FROM (SELECT DISTINCT * FROM w) GROUP BY 1, 2""",
)
def name_tokens(t):
    """Distinct words of a name; repeated ones count once."""
    norm = names.normal_form(company_name())
    words = names.words_of(F.concat_ws(" ", norm, norm))
    return t.part.select("p_partkey", F.explode(words).alias("word")).groupBy("p_partkey", "word").agg(F.count("*").alias("copies"))


def _jaro_winkler_sql(pairs: str, name: str) -> str:
    """CTEs that give ``name``(a, b, score) for the rows of ``pairs``(a, b), letter by letter.

    ``hit``: for each letter of a the place in b it is matched with, the first free one in reach, or 0.
    """
    reach = "greatest(0, greatest(len(a), len(b)) // 2 - 1)"
    prefix = f"list_max(list_filter(range({fixed.WINKLER_PREFIX + 1}), lambda k: k <= least(len(a), len(b)) AND a[1:k] = b[1:k]))"
    return f"""{name}_1 AS (SELECT a, b, list_reduce([[]::BIGINT[]] || list_transform(range(1, len(a) + 1), lambda i: [i]), lambda done, i: done || [coalesce(list_filter(
      range(greatest(1, i[1] - {reach}), least(len(b), i[1] + {reach}) + 1), lambda j: b[j] = a[i[1]] AND NOT list_contains(done, j))[1], 0)]) AS hit FROM {pairs}),
{name}_2 AS (SELECT a, b, list_transform(list_filter(range(1, len(a) + 1), lambda i: hit[i] > 0), lambda i: a[i]) AS mine, list_transform(list_sort(list_filter(hit, lambda j: j > 0)), lambda j: b[j]) AS theirs FROM {name}_1),
{name}_3 AS (SELECT a, b, len(mine) AS m, len(list_filter(range(1, len(mine) + 1), lambda k: mine[k] <> theirs[k])) AS crossed, {prefix} AS same FROM {name}_2),
{name}_4 AS (SELECT *, CASE WHEN m = 0 THEN 0.0::DOUBLE ELSE (m::DOUBLE / len(a) + m::DOUBLE / len(b) + (m - crossed::DOUBLE / 2) / m) / 3 END AS jaro FROM {name}_3),
{name} AS (SELECT a, b, CASE WHEN a = b THEN 1.0::DOUBLE WHEN jaro < {fixed.WINKLER_FLOOR}::DOUBLE THEN jaro ELSE jaro + same * {fixed.WINKLER_SCALE}::DOUBLE * (1 - jaro) END AS score FROM {name}_4)"""


@query(
    "jaro_winkler",
    f"""WITH p AS (SELECT DISTINCT x.p_name AS a, y.p_name AS b FROM lineitem l JOIN lineitem r ON r.l_orderkey = l.l_orderkey AND r.l_linenumber = l.l_linenumber + 1
      JOIN part x ON x.p_partkey = l.l_partkey JOIN part y ON y.p_partkey = r.l_partkey),
    {_jaro_winkler_sql("p", "w")} SELECT a AS p_name, b AS other, score FROM w""",
)
def jaro_winkler(t):
    """Scores of the distinct pairs of names that stand in neighbouring lines of an order."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("p_name").alias("other"))
    pairs = lines.join(after, ["l_orderkey", "l_linenumber"]).select("p_name", "other").distinct()
    return pairs.withColumn("score", names.jaro_winkler("p_name", "other"))


@query(
    "token_set_score",
    f"""WITH p AS (SELECT DISTINCT x.p_name || ' ' || x.p_brand AS a, y.p_brand || ' ' || y.p_name AS b FROM lineitem l JOIN lineitem r ON r.l_orderkey = l.l_orderkey AND r.l_linenumber = l.l_linenumber + 1
      JOIN part x ON x.p_partkey = l.l_partkey JOIN part y ON y.p_partkey = r.l_partkey),
    s AS (SELECT a, b, list_distinct(string_split(lower(a), ' ')) AS aw, list_distinct(string_split(lower(b), ' ')) AS bw FROM p),
    v AS (SELECT DISTINCT x AS a, y AS b FROM (SELECT unnest(aw) AS x, bw FROM s), unnest(bw) u(y)), {_jaro_winkler_sql("v", "vw")},
    g AS (SELECT s.a, s.b, len(aw) + len(bw) AS n, list({{'total': 0.0::DOUBLE, 'mine': []::VARCHAR[], 'theirs': []::VARCHAR[], 'word': vw.a, 'similar': vw.b, 'weight': score}}
        ORDER BY score DESC, least(vw.a, vw.b), greatest(vw.a, vw.b), vw.a, vw.b) AS pairs
      FROM s JOIN vw ON list_contains(aw, vw.a) AND list_contains(bw, vw.b) AND score >= {fixed.TOKEN_MATCH_FLOOR} GROUP BY 1, 2, 3),
    o AS (SELECT a, b, 2 * list_reduce([{{'total': 0.0::DOUBLE, 'mine': []::VARCHAR[], 'theirs': []::VARCHAR[], 'word': '', 'similar': '', 'weight': 0.0::DOUBLE}}] || pairs, lambda done, p: CASE
      WHEN list_contains(done.mine, p.word) OR list_contains(done.theirs, p.similar) THEN done
      ELSE {{'total': done.total + p.weight, 'mine': done.mine || [p.word], 'theirs': done.theirs || [p.similar], 'word': p.word, 'similar': p.similar, 'weight': p.weight}} END).total / n AS overlap FROM g)
    SELECT a, b, coalesce(overlap, 0.0::DOUBLE) AS score FROM p LEFT JOIN o USING (a, b)""",
)
def token_set_score(t):
    """Word overlap of names that stand in neighbouring lines of an order, similar words counting as far as they are alike."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey")).join(t.part.select("p_partkey", "p_name", "p_brand"), "p_partkey")
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.concat_ws(" ", "p_brand", "p_name").alias("b"))
    pairs = lines.select("l_orderkey", "l_linenumber", F.concat_ws(" ", "p_name", "p_brand").alias("a")).join(after, ["l_orderkey", "l_linenumber"]).select("a", "b").distinct()
    pairs = pairs.withColumns({"aw": names.words_of(F.lower("a")), "bw": names.words_of(F.lower("b"))})
    soft = reconcile.similar_words(pairs.select(F.explode("aw").alias("word")).distinct(), pairs.select(F.explode("bw").alias("word")).distinct())
    found = pairs.select("a", "b", "bw", F.explode("aw").alias("word")).join(soft, "word").filter(F.array_contains("bw", F.col("similar")))
    met = found.groupBy("a", "b").agg(F.collect_list(F.struct("word", "similar", "weight")).alias("met"))
    score = names.word_overlap(F.col("met"), F.col("aw"), F.col("bw"))
    return pairs.join(met, ["a", "b"], "left").select("a", "b", F.coalesce(score, F.lit(0.0)).alias("score"))


# --- matching ------------------------------------------------------------------
def vendor_reference(t):
    """Vendors named after what they sell and where: part name, nation and brand."""
    sold = (
        t.lineitem.select("l_suppkey", "l_partkey")
        .groupBy("l_suppkey")
        .agg(F.min("l_partkey").alias("p_partkey"))
        .join(t.part, "p_partkey")
        .join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
        .join(t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey"), "s_nationkey")
        .join(t.region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey")
    )
    return sold.select(
        F.lit("r1").alias("realm_id"),
        F.lit("vendor").alias("entity_kind"),
        F.col("l_suppkey").cast("string").alias("entity_id"),
        F.initcap(F.concat_ws(" ", "p_name", "r_name", "p_type", F.replace("p_brand", F.lit("#"), F.lit(" ")))).alias("name"),
        (F.pmod("s_nationkey", F.lit(7)) != 3).alias("active"),
        F.lit(None).cast("string").alias("account_type"),
    )


def account_reference(t):
    return (
        t.part.groupBy("p_type", "p_name")
        .agg(F.min("p_partkey").alias("p_partkey"))
        .select(
            F.lit("r1").alias("realm_id"),
            F.lit("account").alias("entity_kind"),
            F.col("p_partkey").cast("string").alias("entity_id"),
            F.concat_ws(":", "p_type", "p_name").alias("name"),
            F.lit(True).alias("active"),
            F.when(F.col("p_type") == "PROMO", "Bank").otherwise("Expense").alias("account_type"),
        )
    )


def printed_vendors(t):
    """Every line's vendor as printed: full, upper case with a company form, a word short, misspelt, unknown."""
    name = F.col("name")
    n = F.col("l_linenumber")
    printed = (
        F.when(n == 1, name)
        .when(n == 2, F.concat(F.upper(name), F.lit(", L.L.C")))
        .when(n == 3, F.regexp_replace(name, r" [^ ]+ [^ ]+\z", " Co."))
        .when(n == 4, F.regexp_replace(name, "([aeiou])([a-z])", "$2$1"))
        .when(n == 5, F.concat_ws(" ", F.lit("Quality Craft Tools"), F.col("l_returnflag")))
        .otherwise(F.concat(name, F.lit(" Supplies Inc")))
    )
    vendors = vendor_reference(t).select(F.col("entity_id").cast("bigint").alias("l_suppkey"), "name")
    return t.lineitem.join(vendors, "l_suppkey").select(
        "l_orderkey", "l_linenumber", "l_suppkey", printed.alias("query")
    )


_TITLE = "array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')"
_FORMS = ", ".join(f"'{w}'" for w in fixed.COMPANY_FORM_WORDS)


def _normal_sql(texts: str, name: str) -> str:
    """CTEs that give ``name``(text, norm) for the plain texts of ``texts``(text)."""
    return f"""{name}_1 AS (SELECT DISTINCT text, list_filter(string_split(regexp_replace(replace(lower(text), '&', ' and '), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '') AS ws FROM {texts}),
{name}_2 AS (SELECT text, ws, list_filter(ws, lambda w: w NOT IN ({_FORMS})) AS kept FROM {name}_1),
{name} AS (SELECT text, array_to_string(CASE WHEN len(kept) > 0 THEN kept ELSE ws END, ' ') AS norm FROM {name}_2)"""


def _ranked_sql(asked: str, offered: str, kind: str = "v") -> str:
    """CTEs that end with ``<kind>_ranked``: the five best options (id, name, text) of ``offered`` for each text of ``asked``.

    Words are weighed once, every two of both vocabularies; names that share no similar word stay below the
    floor, as letters alone reach it for equal names only. Pairs of words are made heaviest first, each word once.
    """
    words = "list_distinct(string_split(norm, ' '))"
    return f"""{_normal_sql(asked, f"{kind}_qn")}, {_normal_sql(f"(SELECT text FROM {offered})", f"{kind}_pn")},
{kind}_qw AS (SELECT DISTINCT norm, {words} AS ws FROM {kind}_qn WHERE norm <> ''), {kind}_ow AS (SELECT DISTINCT norm, {words} AS ws FROM {kind}_pn WHERE norm <> ''),
{kind}_v AS (SELECT x.a, y.b FROM (SELECT DISTINCT unnest(ws) AS a FROM {kind}_qw) x CROSS JOIN (SELECT DISTINCT unnest(ws) AS b FROM {kind}_ow) y),
{_jaro_winkler_sql(f"{kind}_v", f"{kind}_vw")},
{kind}_met AS (SELECT q.norm AS a, o.norm AS b, len(q.ws) + len(o.ws) AS n, list({{'total': 0.0::DOUBLE, 'mine': []::VARCHAR[], 'theirs': []::VARCHAR[], 'word': {kind}_vw.a, 'similar': {kind}_vw.b, 'weight': score}}
    ORDER BY score DESC, least({kind}_vw.a, {kind}_vw.b), greatest({kind}_vw.a, {kind}_vw.b), {kind}_vw.a, {kind}_vw.b) AS pairs
  FROM (SELECT norm, ws, unnest(ws) AS word FROM {kind}_qw) q JOIN {kind}_vw ON {kind}_vw.a = q.word AND score >= {fixed.TOKEN_MATCH_FLOOR} JOIN (SELECT norm, ws, unnest(ws) AS word FROM {kind}_ow) o ON o.word = {kind}_vw.b GROUP BY 1, 2, 3),
{kind}_made AS (SELECT a, b, 2 * list_reduce([{{'total': 0.0::DOUBLE, 'mine': []::VARCHAR[], 'theirs': []::VARCHAR[], 'word': '', 'similar': '', 'weight': 0.0::DOUBLE}}] || pairs, lambda done, p: CASE
    WHEN list_contains(done.mine, p.word) OR list_contains(done.theirs, p.similar) THEN done
    ELSE {{'total': done.total + p.weight, 'mine': done.mine || [p.word], 'theirs': done.theirs || [p.similar], 'word': p.word, 'similar': p.similar, 'weight': p.weight}} END).total / n AS overlap FROM {kind}_met),
{kind}_hope AS (SELECT a, b, overlap FROM {kind}_made WHERE {fixed.TOKEN_WEIGHT} * overlap + {fixed.CHARACTER_WEIGHT} >= {fixed.CANDIDATE_FLOOR} - 0.0001),
{_jaro_winkler_sql(f"{kind}_hope", f"{kind}_hw")},
{kind}_scored AS (SELECT a, b, floor(CASE WHEN a = b THEN 1.0 ELSE least(1.0, greatest(0.0, {fixed.TOKEN_WEIGHT}::DOUBLE * overlap + {fixed.CHARACTER_WEIGHT}::DOUBLE * score)) END * 10000 + 0.5) / 10000 AS score FROM {kind}_hope JOIN {kind}_hw USING (a, b)),
{kind}_ranked AS (SELECT {kind}_qn.text AS query, row_number() OVER (PARTITION BY {kind}_qn.text ORDER BY score DESC, o.name, o.id)::INTEGER AS candidate_rank, o.id, o.name, score
  FROM {kind}_scored JOIN {kind}_qn ON {kind}_qn.norm = a JOIN {kind}_pn ON {kind}_pn.norm = b JOIN {offered} o ON o.text = {kind}_pn.text WHERE score >= {fixed.CANDIDATE_FLOOR} QUALIFY candidate_rank <= {fixed.MAX_CANDIDATES})"""


_TIER_SQL = f"""CASE WHEN max(score) < {fixed.SUGGEST_FLOOR} THEN 'none' WHEN max(score) >= {fixed.AUTO_SCORE} AND (count(*) = 1 OR max(score) - max(score) FILTER (candidate_rank = 2) >= {fixed.AUTO_MARGIN}::DOUBLE) THEN 'auto' ELSE 'suggested' END"""
_VENDORS_SQL = f"""sold AS (SELECT l_suppkey, min(l_partkey) AS partkey FROM lineitem GROUP BY 1),
vendors AS (SELECT l_suppkey, s_nationkey % 7 <> 3 AS active, {_TITLE.format("concat_ws(' ', p_name, r_name, p_type, replace(p_brand, '#', ' '))")} AS name
  FROM sold JOIN part ON p_partkey = partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
printed AS (SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_linenumber = 1 THEN name WHEN l_linenumber = 2 THEN upper(name) || ', L.L.C' WHEN l_linenumber = 3 THEN regexp_replace(name, ' [^ ]+ [^ ]+$', ' Co.')
  WHEN l_linenumber = 4 THEN regexp_replace(name, '([aeiou])([a-z])', '\\2\\1', 'g') WHEN l_linenumber = 5 THEN 'Quality Craft Tools ' || l_returnflag ELSE name || ' Supplies Inc' END AS query FROM lineitem JOIN vendors USING (l_suppkey)),
asked AS (SELECT DISTINCT query AS text FROM printed), offered AS (SELECT CAST(l_suppkey AS VARCHAR) AS id, name, name AS text FROM vendors WHERE active),
{_ranked_sql("asked", "offered")}"""


@query("match_vendor", f"WITH {_VENDORS_SQL} SELECT 'r1' AS realm_id, query, candidate_rank, id AS option_id, name AS option_name, score FROM v_ranked")
def match_vendor(t):
    """Ranked vendor candidates of every distinct printed name."""
    asked = printed_vendors(t).select(F.lit("r1").alias("realm_id"), "query")
    return reconcile.rank_candidates(asked, reconcile.vendor_options(vendor_reference(t)))


@query(
    "match_tier",
    f"""WITH {_VENDORS_SQL}, t AS (SELECT query, {_TIER_SQL} AS level, max(id) FILTER (candidate_rank = 1) AS best FROM v_ranked GROUP BY 1)
    SELECT coalesce(level, 'none') AS confidence, CASE WHEN level <> 'none' THEN best END IS NOT DISTINCT FROM CAST(l_suppkey AS VARCHAR) AS "right", count(*) AS lines FROM printed LEFT JOIN t USING (query) GROUP BY 1, 2""",
)
def match_tier(t):
    """Lines per match tier and whether the answer is the true vendor."""
    # lines of one vendor and printed name have one answer: they are counted before the join
    lines = cut_lineage(printed_vendors(t).groupBy("l_suppkey", "query").agg(F.count("*").alias("_lines")))
    answers = reconcile.match_texts(
        lines.select(F.lit("r1").alias("realm_id"), "query"), reconcile.vendor_options(vendor_reference(t))
    )
    return (
        lines.join(answers.select("query", "selected_id", "confidence"), "query", "left")
        .groupBy(F.coalesce("confidence", F.lit("none")).alias("confidence"), F.col("selected_id").eqNullSafe(F.col("l_suppkey").cast("string")).alias("right"))
        .agg(F.sum("_lines").alias("lines"))
    )


_ANSWER_SQL = f"""SELECT query, {_TIER_SQL} AS level, max(id) FILTER (candidate_rank = 1) AS best FROM {{0}} GROUP BY 1"""


@query(
    "match_batch",
    f"""WITH {_VENDORS_SQL}, parsed AS (SELECT l_orderkey, first(query ORDER BY l_linenumber, query) AS vendor, min('small ' || lower(query)) AS category FROM printed GROUP BY 1),
    leaves AS (SELECT CAST(min(p_partkey) AS VARCHAR) AS id, p_type || ':' || p_name AS name, p_name AS text FROM part WHERE p_type <> 'PROMO' GROUP BY p_type, p_name),
    small AS (SELECT DISTINCT category AS text FROM parsed), {_ranked_sql("small", "leaves", "c")},
    va AS ({_ANSWER_SQL.format("v_ranked")}), ca AS ({_ANSWER_SQL.format("c_ranked")})
    SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS file_hash, CASE WHEN va.level <> 'none' THEN va.best END AS vendor_selected_id, coalesce(va.level, 'none') AS vendor_confidence,
      CASE WHEN ca.level <> 'none' THEN ca.best END AS category_selected_id, coalesce(ca.level, 'none') AS category_confidence, CAST(NULL AS VARCHAR) AS error
    FROM orders LEFT JOIN parsed ON l_orderkey = o_orderkey LEFT JOIN va ON va.query = vendor LEFT JOIN ca ON ca.query = category""",
)
def match_batch(t):
    """Vendor and category answer per order, through the parse table."""
    answers = _batch_answers(t, _batch_parsed(t))
    return answers.select("file_hash", "vendor_selected_id", "vendor_confidence", "category_selected_id", "category_confidence", "error")


def _batch_parsed(t):
    # the digest of an order's number is made once its lines are one row
    return (
        printed_vendors(t)
        .groupBy("l_orderkey")
        .agg(F.min_by("query", F.struct("l_linenumber", "query")).alias("vendor"), F.min(F.concat(F.lit("small "), F.lower("query"))).alias("suggested_category"))
        .select(F.sha2(F.col("l_orderkey").cast("string"), 256).alias("file_hash"), "vendor", "suggested_category", F.lit(2).alias("schema_version"))
    )


def _batch_answers(t, parsed):
    hashes = t.orders.select(F.lit("r1").alias("realm_id"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("file_hash"))
    both = vendor_reference(t).unionByName(account_reference(t))
    return reconcile.match_batch(hashes, parsed, both)


@query(
    "category_outcomes",
    f"""WITH {_VENDORS_SQL}, phrases AS (SELECT l_orderkey, min('small ' || lower(query)) AS phrase FROM printed GROUP BY 1),
    answers AS ({ORACLES["match_batch"]}),
    d AS (SELECT phrase, category_confidence IN ('auto', 'suggested') AS resolved, category_selected_id AS id FROM orders LEFT JOIN phrases ON l_orderkey = o_orderkey LEFT JOIN answers ON file_hash = sha256(CAST(o_orderkey AS VARCHAR)))
    SELECT count(*) AS documents, count(*) FILTER (coalesce(trim(phrase), '') <> '') AS inferred, count(*) FILTER (len(regexp_split_to_array(trim(phrase), '\\s+')) > 4) AS long_phrases,
      count(*) FILTER (resolved) AS resolved, count(*) FILTER (resolved) / nullif(count(*), 0)::DOUBLE AS resolved_share, count(*) FILTER (resolved AND id IS NULL) AS without_record,
      count(*) FILTER (id IS NOT NULL AND id NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_type <> 'PROMO')) AS not_expense FROM d""",
)
def category_outcomes(t):
    """How many of the orders' category phrases the matcher resolves, and whether always to an expense account."""
    parsed = cut_lineage(_batch_parsed(t))
    phrases = parsed.select("file_hash", F.col("suggested_category").alias("phrase"))
    documents = t.orders.select(F.lit("r1").alias("realm_id"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("file_hash")).join(phrases, "file_hash", "left")
    return evaluate.category_outcomes(documents, _batch_answers(t, parsed), account_reference(t))


@query(
    "vendors_to_create",
    """SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS file_hash, 'Customer ' || o_custkey AS display_name FROM orders WHERE o_orderstatus <> 'F'""",
)
def vendors_to_create(t):
    """Rows without a vendor, with the printed name to start a record from."""
    status = F.col("o_orderstatus")
    rows = t.orders.select(
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("file_hash"),
        F.when(status == "F", "7").when(status == "O", "").alias("vendor_id"),
        F.concat(F.lit("  Customer "), F.col("o_custkey").cast("string"), F.lit(" ")).alias("printed_vendor"),
    )
    return reconcile.vendors_to_create(rows)
