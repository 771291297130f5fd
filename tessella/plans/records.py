"""Registered queries of nested records, joins, sources, scalar functions and event folds on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import scalars
from tessella.operators import joins, nested, reshape
from tessella.plans.registry import query, table
from tessella.sources import proteomics, tables
from tessella.streaming import events as ev


@query("SELECT l_orderkey, l_partkey FROM lineitem")
def flatten_lists(spark, sf_dir):
    """Lists of lists of part keys, by return flag within an order, made plain again."""
    inner = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.collect_list("l_partkey").alias("keys"))
    lists = inner.groupBy("l_orderkey").agg(F.collect_list("keys").alias("keys"))
    return lists.select("l_orderkey", F.explode(nested.flatten_list(F.col("keys"), 2)).alias("l_partkey"))


@query("""SELECT p_partkey, unnest(['id', 'brand', 'price', 'size', 'Type']) AS key,
    unnest([CAST(p_partkey AS VARCHAR), p_brand, CAST(round(p_retailprice, 4) AS VARCHAR), CAST(CAST(p_size AS DOUBLE) AS VARCHAR), p_type]) AS value FROM part""")
def key_value_lists(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.struct(F.col("p_size").alias("size"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"), F.lit("A").alias("alt"), F.col("p_type").alias("Type")).alias("track"))
    pairs = part.select("p_partkey", F.explode(nested.key_value_lists(part, "track", ("track.id",))).alias("pair"))
    return pairs.select("p_partkey", F.col("pair")[0].alias("key"), F.col("pair")[1].alias("value"))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 3 AS kind FROM orders), k AS (SELECT l_orderkey, l_partkey FROM lineitem)
    SELECT o_orderkey, l_partkey FROM o JOIN k ON l_orderkey = o_orderkey AND kind = 0 UNION ALL SELECT o_orderkey, NULL FROM o WHERE kind = 1 AND o_orderkey IN (SELECT l_orderkey FROM k)""")
def explode_rows_with_list(spark, sf_dir):
    """Lists are exploded, a null keeps its row, an empty list drops it."""
    keys = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_partkey").alias("l_partkey"))
    kind = F.col("o_orderkey") % 3
    lists = keys.withColumn("l_partkey", F.when(kind == 0, F.col("l_partkey")).when(kind == 2, F.slice("l_partkey", 1, 0)))
    return nested.explode_rows_with_list(lists, "l_partkey")


@query("""SELECT c_custkey, regexp_matches(v, '^[-+]?([0-9]+(_[0-9]+)*)(\\.[0-9]*)?$') AS number
    FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN CAST(c_custkey AS VARCHAR) || '.5' WHEN 2 THEN c_name ELSE '1_' || CAST(c_custkey AS VARCHAR) END AS v FROM customer)""")
def number_texts(spark, sf_dir):
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, F.concat(k.cast("string"), F.lit(".5"))).when(k % 4 == 2, F.col("c_name")).otherwise(F.concat(F.lit("1_"), k.cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", nested.looks_like_number(text).alias("number"))


@query("SELECT s_suppkey AS id, n_name AS name, s_acctbal AS extra FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def projected_fields(spark, sf_dir):
    """Identity fields first, then the fields asked for in that order; others go."""
    both = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = both.select(F.col("s_acctbal").alias("extra"), F.col("n_name").alias("name"), F.col("s_suppkey").alias("id"), F.col("n_comment").alias("other") if "n_comment" in both.columns else F.lit("x").alias("other"))
    return nested.project(rows, ["name", "extra", "name"])


@query("SELECT s_suppkey, upper(s_name) AS name, n_name, s_name AS name_y FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def callback_join(spark, sf_dir):
    """The abundance join with both sides' identifiers mapped first, and a name that both sides have."""
    left = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("sample"), F.lit("g").alias("refSeq.name2"), "n_name", F.lit("n").alias("name"))
    right = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_nationkey").cast("string")).alias("sid"), F.lit("g").alias("gene"), "s_suppkey", F.col("s_name").alias("name"))
    out = joins.join_proteomics(left, right, protein_gene="gene", protein_sample="sid", map_variant_sample=lambda c: F.concat(F.lit("n"), c), map_protein_sample=lambda c: F.regexp_replace(c, "^S", "n"))
    return out.select("s_suppkey", F.upper("name_y").alias("name"), "n_name", "name_y")


@query("SELECT o_orderkey AS row_id, o_totalprice, o_orderstatus FROM orders")
def bound_columns(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "row_id")
    return joins.bind_columns(o.select("row_id", "o_totalprice"), o.select("row_id", "o_orderstatus"))


@query("SELECT s_suppkey, n_name AS gene_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def strict_lookup(spark, sf_dir):
    """A look-up that would fail if any identifier were unknown."""
    mapping = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("uniprot_accession"), F.col("n_name").alias("gene_name"))
    return joins.lookup_genes(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", mapping, strict=True).select("s_suppkey", "gene_name")


@query("SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def unknown_ids(spark, sf_dir):
    return joins.unknown_ids(table(spark, sf_dir, "customer"), "c_nationkey", table(spark, sf_dir, "nation").where("n_regionkey = 1"), "n_nationkey")


@query("SELECT s_suppkey AS sample, p_brand AS Target, sum(l_quantity) AS RFU, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")
def somascan_melt(spark, sf_dir):
    """A matrix of suppliers and brands as three tables, one row per pair with the fields of both."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rfu = line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("row_id"), F.col("p_brand").alias("column_id")).agg(F.sum("l_quantity").alias("RFU"))
    samples = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_id"), F.col("s_suppkey").alias("sample"), "s_name")
    analytes = part.select(F.col("p_brand").alias("column_id"), F.col("p_brand").alias("Target")).distinct()
    return proteomics.SomascanDataset(samples, analytes, rfu).melt()


@query("""SELECT CAST(c_custkey AS VARCHAR) AS sample_id, c_name AS subject_id, NULL AS sex, n_name AS population, NULL AS superpopulation FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def covariates(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return tables.covariates(c.select(F.col("c_custkey").alias("Sample_ID"), F.col("c_name").alias("SUBJECT_ID "), F.col("n_name").alias("Population"), F.col("c_acctbal").alias("unknown")))


@query("SELECT CAST(n_regionkey AS VARCHAR) AS uniprot_accession, n_name AS gene_name FROM nation WHERE n_nationkey % 3 <> 0")
def gene_mapping(spark, sf_dir):
    """Entries (accession, genes of lists of names) as pairs; names that are null go."""
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("accession"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("name"))
    entries = n.groupBy("accession").agg(F.array(F.struct(F.sort_array(F.collect_list(F.coalesce("name", F.lit("?")))).alias("names"))).alias("genes"))
    entries = entries.withColumn("genes", F.transform("genes", lambda g: F.struct(F.transform(g["names"], lambda x: F.nullif(x, F.lit("?"))).alias("names"))))
    return tables.gene_mapping(entries)


@query("""SELECT event_id, least(15, power(2, event_id % 6)) AS delay, s IN (408, 429) OR (s >= 500 AND s < 600) AS again FROM (SELECT event_id, 400 + event_id % 200 AS s FROM events)""")
def retries(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", tables.retry_delay(F.col("event_id") % 6).alias("delay"), tables.retryable(400 + F.col("event_id") % 200).alias("again"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS ID, unnest(['a', 'b']) AS sample, unnest([CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, CASE WHEN p_size % 5 = 0 THEN NULL ELSE 1 END]) AS dosage FROM part""")
def genotypes_long(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    first = F.when(F.col("p_size") % 3 == 0, "0|0").when(F.col("p_size") % 3 == 1, "0|1:9").otherwise("1/2")
    vcf = p.select(F.col("p_partkey").cast("string").alias("ID"), first.alias("a"), F.when(F.col("p_size") % 5 == 0, ".|1").otherwise("1|0").alias("b"))
    return tables.genotypes_long(vcf, ["a", "b"])


@query(r"""SELECT doc_id, regexp_replace(translate(t, chr(9) || chr(10) || chr(13), '   '), '[\x00-\x1f\x7f]', '', 'g') AS clean, strpos(text, ' ') > 0 AS spaced FROM (SELECT doc_id, text, text AS t FROM documents)""")
def terminal_texts(spark, sf_dir):
    """Whole texts with colours and control characters put in, taken out again."""
    d = table(spark, sf_dir, "documents")
    noisy = F.concat(F.lit("\x1b[31m"), F.col("text"), F.lit("\x1b[0m\x07"))
    return d.select("doc_id", scalars.clean_terminal(noisy).alias("clean"), (F.instr("text", " ") > 0).alias("spaced"))


@query("""SELECT a.n_nationkey AS a, b.n_nationkey AS b, CAST((SELECT count(*) FROM range(1, 30) t(k) WHERE k <= length(a.n_name) AND k <= length(b.n_name) AND substr(a.n_name, 1, CAST(k AS INTEGER)) = substr(b.n_name, 1, CAST(k AS INTEGER))) AS INTEGER) AS shared
    FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey""")
def common_prefixes(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    pairs = n.alias("l").join(n.alias("r"), F.col("l.n_regionkey") == F.col("r.n_regionkey"))
    return pairs.select(F.col("l.n_nationkey").alias("a"), F.col("r.n_nationkey").alias("b"), scalars.common_prefix_length(F.col("l.n_name"), F.col("r.n_name")).alias("shared"))


@query("""SELECT page_id, scheme || '://' || lower(regexp_extract(full_url, '^[^:]+://([^/:?#]+)', 1)) || ':' || CASE WHEN regexp_extract(full_url, '^[^:]+://[^/:?#]+:([0-9]+)', 1) <> '' THEN regexp_extract(full_url, '^[^:]+://[^/:?#]+:([0-9]+)', 1) WHEN scheme = 'http' THEN '80' ELSE '443' END AS address
    FROM (SELECT page_id, full_url, lower(regexp_extract(full_url, '^([^:]+)://', 1)) AS scheme FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN url ELSE 'https://' || url END AS full_url FROM pages))""")
def page_addresses(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", scalars.normal_url(F.col("url")).alias("address"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms, TRUE AS same, event_id % 2 = 0 AS parsed FROM events")
def event_times(spark, sf_dir):
    """Times to milliseconds and to text and back; text that is no time gives null."""
    e = table(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise("soon")
    return e.select("event_id", ms.alias("ms"), (F.unix_millis(scalars.from_epoch_ms(ms)) == ms).alias("same"), scalars.from_iso(text).isNotNull().alias("parsed"))


@query("SELECT event_id, round(x + ln(-(exp(-x) - 1)), 6) AS raw FROM (SELECT event_id, value + 0.1 AS x FROM events WHERE value IS NOT NULL)")
def inverse_softplus(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null")
    return e.select("event_id", F.round(scalars.inverse_softplus(F.col("value") + 0.1), 6).alias("raw"))


@query("SELECT CAST(i AS INTEGER) // 2 AS i, CAST(j AS INTEGER) // 2 AS j, v FROM (SELECT s_nationkey AS i, s_suppkey % 25 AS j, round(sum(s_acctbal), 4) AS v FROM supplier GROUP BY 1, 2) WHERE i % 2 = 0 AND j % 2 = 0")
def submatrix(spark, sf_dir):
    """Even rows and columns of a matrix, renumbered."""
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("i"), (F.col("s_suppkey") % 25).cast("int").alias("j")).agg(F.round(F.sum("s_acctbal"), 4).alias("v"))
    return reshape.submatrix(s, [1 - k % 2 for k in range(25)])


LATEST = """WITH k AS (SELECT *, CASE turn % 3 WHEN 1 THEN 'error' WHEN 2 THEN 'stopped' ELSE 'plain' END AS kind FROM conversations), u AS (SELECT conv_id, max(turn) AS u FROM conversations WHERE role = 'user' GROUP BY 1)
    SELECT k.conv_id, max(k.turn) AS turn, kind FROM k LEFT JOIN u USING (conv_id) WHERE kind <> 'plain' AND (u IS NULL OR turn > u) GROUP BY k.conv_id, kind"""


@query(LATEST)
def latest_errors_and_stops(spark, sf_dir):
    kind = F.when(F.col("turn") % 3 == 1, "error").when(F.col("turn") % 3 == 2, "stopped").otherwise("plain")
    rows = table(spark, sf_dir, "conversations").withColumn("kind", kind)
    both = ev.latest_error(rows, "conv_id", "turn", "role", "kind").unionByName(ev.latest_stop(rows, "conv_id", "turn", "role", "kind"))
    return both.select("conv_id", "turn", "kind")


@query("SELECT DISTINCT user_id AS run_id, event_id % 5 AS message_id FROM events WHERE event_type = 'purchase'")
def completed_once(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), (F.col("event_id") % 5).alias("message_id"), F.when(F.col("event_type") == "purchase", "completed").otherwise("append").alias("change"))
    return ev.completions(e).select("run_id", "message_id")


@query("""SELECT event_id, event_type AS active, event_type || ' (' || CAST(event_id % 7 AS VARCHAR) || '/9)' AS message, event_id % 2 = 0 AS done FROM events WHERE event_id % 3 <> 0""")
def progress_cards(spark, sf_dir):
    """Cards from JSON metadata: the active phase's label and count; rows of other sections go."""
    e = table(spark, sf_dir, "events")
    phase = lambda state, label: F.struct(F.lit("p").alias("id"), F.lit("k").alias("kind"), F.lit(state).alias("state"), label.alias("label"), F.struct((F.col("event_id") % 7).alias("done"), F.lit(9).alias("total")).alias("count"))
    progress = F.struct((F.col("event_id") % 2 == 0).alias("done"), F.array(phase("done", F.lit("first")), phase("active", F.col("event_type"))).alias("phases"))
    meta = F.to_json(F.struct(F.when(F.col("event_id") % 3 != 0, "progress").otherwise("other").alias("section"), progress.alias("progress")))
    return ev.progress_phases(e.select("event_id", meta.alias("meta")), "meta").select("event_id", "active", "message", "done")
