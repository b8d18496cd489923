"""Queries over sources, sinks, pictures, functions and streams, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantgrove.functions import containers, hashing
from quantgrove.functions.arithmetic import draw_sql, uniform_sql
from quantgrove.operators import drift, feedback, idset, images, quantizer, reports, sampling
from quantgrove.plans.models import FIXED, ONE, unique
from quantgrove.plans.queries import BAGS, BINS, GREY, HOG, PIXELS, SETS, UNIFORMS, _quantizer, _run_stream, _sets, binned, event_stream, pictures, query, table
from quantgrove.sources import artefacts, config, csv, packed
from quantgrove.sources import images as folders
from quantgrove.sources.shared import scratch

NAMES = [f"bin_{i}" for i in range(4)]

# --- text ------------------------------------------------------------------------


@query("SELECT c_mktsegment AS label, cast(c_custkey AS double) AS f0, cast(c_custkey % 7 AS double) AS f1, 0.0e0 AS f2 FROM customer WHERE c_custkey % 11 <> 0")
def csv_scan(spark, sf_dir):
    """A file with header, label last, a numeric prefix, a text cell, and ragged and blank lines, read back."""
    df = table(spark, sf_dir, "customer")
    line = F.concat_ws(" , ", "c_custkey", F.concat((F.col("c_custkey") % 7).cast("string"), F.lit("abc")), F.lit("x3"), "c_mktsegment")
    line = F.when(F.col("c_custkey") % 11 == 0, F.when(F.col("c_custkey") % 2 == 0, "  ").otherwise(F.concat(line, F.lit(",1")))).otherwise(F.concat(line, F.when(F.col("c_custkey") % 5 == 0, ",").otherwise("")))
    path = scratch(spark, "text")
    head = spark.createDataFrame([("key, part, word, segment",)], "value string")
    head.union(df.select(line.alias("value"))).coalesce(1).write.text(path)
    return csv.read(spark, path, label=-1, header=True, max_features=3)


@query("SELECT c_custkey % 3 = 0 AS header, count(*) AS n FROM customer GROUP BY 1")
def csv_header_rows(spark, sf_dir):
    """Only the first line that equals the header is one; later ones are data."""
    df = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 3 == 0, "name,size").otherwise(F.concat(F.lit("a,"), "c_custkey")).alias("value"))
    path = scratch(spark, "text")
    spark.createDataFrame([("name,size",)], "value string").union(df).coalesce(1).write.text(path)
    return csv.read(spark, path, header=True).groupBy((F.col("label") == "name").alias("header")).agg(F.count("*").alias("n"))


WHOLE_ROWS = "SELECT cast(l_linenumber AS int) AS label, cast(l_quantity AS int) % 6 AS bin_0, cast(l_suppkey % 4 AS int) AS bin_1 FROM lineitem WHERE l_partkey % 9 <> 0"


def _integer_lines(spark, sf_dir) -> str:
    df, path = table(spark, sf_dir, "lineitem"), scratch(spark, "bins")
    line = F.concat_ws(",", "l_linenumber", F.col("l_quantity").cast("int") % 6, F.col("l_suppkey") % 4)
    df.select(F.when(F.col("l_partkey") % 9 != 0, line).when(F.col("l_partkey") % 2 == 0, F.concat(line, F.lit(",x"))).otherwise("1,two,3").alias("value")).write.text(path)
    return path


@query(f"SELECT label, bin_0, bin_1, count(*) AS n FROM ({WHOLE_ROWS}) WHERE bin_0 <= 3 GROUP BY ALL")
def integer_csv_scan(spark, sf_dir):
    return csv.read_bins(spark, _integer_lines(spark, sf_dir), 2, bits=2).groupBy("label", "bin_0", "bin_1").agg(F.count("*").alias("n"))


@query(f"SELECT label, bin_0, bin_1, count(*) AS n FROM ({WHOLE_ROWS}) GROUP BY ALL")
def integer_csv_unchecked(spark, sf_dir):
    return csv.read_bins(spark, _integer_lines(spark, sf_dir), 2).groupBy("label", "bin_0", "bin_1").agg(F.count("*").alias("n"))


@query(f"WITH {BINS} SELECT label, bin_0, bin_1, bin_2, bin_3, count(*) AS n FROM b GROUP BY ALL")
def features_csv(spark, sf_dir):
    """Written shuffled, read back."""
    path = scratch(spark, "features")
    csv.write_features(binned(spark, sf_dir), path, "label", NAMES, "row_id", seed=5)
    got = spark.read.schema("label string, bin_0 int, bin_1 int, bin_2 int, bin_3 int").csv(path)
    return got.groupBy("label", *NAMES).agg(F.count("*").alias("n"))


@query(f"WITH {UNIFORMS}, x AS (SELECT p, (u0 - 0.5) * 20 AS x1, (u1 - 0.5) * 20 AS x2 FROM u) SELECT printf('%.6f', x1) AS x1, printf('%.6f', x2) AS x2, cast(CASE WHEN x1 * cos(p * pi()) - x2 * sin(p * pi()) >= 0 THEN 0 ELSE 1 END AS varchar) AS label FROM x")
def drift_csv(spark, sf_dir):
    path = scratch(spark, "drift")
    drift.write_stream_csv(drift.generate(spark, drift.DriftOptions(rows=6000, burn_in=1000, width=2000)), path)
    return spark.read.option("header", "true").csv(path)


@query("""
WITH d AS (SELECT c_mktsegment AS l, count(*) AS k, row_number() OVER (ORDER BY c_mktsegment) - 1 AS i FROM customer GROUP BY 1)
SELECT 'quantization_coefficient' AS parameter, CAST(2 AS BIGINT) AS value UNION ALL SELECT 'num_features', 1 UNION ALL SELECT 'num_samples', cast(sum(k) AS BIGINT) FROM d UNION ALL SELECT 'num_labels', count(*) FROM d
UNION ALL SELECT 'samples_label_' || i, k FROM d WHERE i < 3
""")
def dataset_params_read(spark, sf_dir):
    """Written and read back by a reader that takes three labels."""
    path = scratch(spark, "params")
    csv.write_params(csv.dataset_params(table(spark, sf_dir, "customer"), "c_mktsegment", 1, 2), path)
    return spark.createDataFrame(list(csv.read_params(spark, path, 3).items()), "parameter string, value long")


@query("SELECT event_type AS event, count(*) AS n, min(event_id % 900 + 100) AS least_heap, round(max(1 - (event_id % 50 + 50) / (event_id % 900 + 100)), 6) AS most_fragmented, cast(min(event_id) AS double) AS first, cast(max(event_id) AS double) AS last FROM events WHERE event_id % 13 <> 0 GROUP BY 1")
def memory_log(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    whole = F.concat_ws(", ", "event_id", F.col("event_id") % 900 + 100, F.col("event_id") % 50 + 50, F.lit(7), "event_type")
    lines = df.select(F.when(F.col("event_id") % 13 == 0, "Time(s), FreeHeap, Largest_Block, FreeDisk, Event").otherwise(whole).alias("value"))
    return reports.memory_by_event(reports.memory_log(lines)).withColumn("most_fragmented", F.round("most_fragmented", 6))


@query("""
WITH d AS (SELECT c_mktsegment AS l, row_number() OVER (ORDER BY c_mktsegment) - 1 AS i FROM customer GROUP BY 1)
SELECT c_custkey, l AS label, l IS NOT NULL AS success FROM customer LEFT JOIN d ON c_custkey % 7 = i
""")
def label_decode(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    coded = df.select("c_custkey", (F.col("c_custkey") % 7).cast("int").alias("predicted"))
    return feedback.decode_labels(coded, csv.label_dictionary(df, "c_mktsegment"), "predicted").select("c_custkey", "label", "success")


@query("""
WITH k AS (SELECT c_mktsegment AS l, row_number() OVER (ORDER BY c_mktsegment) - 1 AS i FROM customer WHERE c_mktsegment > 'F' GROUP BY 1), n AS (SELECT c_mktsegment AS l, row_number() OVER (ORDER BY c_mktsegment) + (SELECT max(i) FROM k) AS i FROM customer WHERE c_mktsegment NOT IN (SELECT l FROM k) GROUP BY 1)
SELECT c_custkey, cast(i AS int) AS label_id FROM customer JOIN (SELECT * FROM k UNION ALL SELECT * FROM n) ON l = c_mktsegment
""")
def label_encode_online(spark, sf_dir):
    """Labels that come later get ids after the known ones."""
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    known = csv.label_dictionary(df.where("c_mktsegment > 'F'"), "c_mktsegment")
    return csv.encode(df, csv.extend_dictionary(known, df, "c_mktsegment"), "c_mktsegment", None).select("c_custkey", "label_id")


@query("SELECT * FROM (VALUES ('bits', '3'), ('clip', 'true'), ('depth', '9'), ('missing', 'none'), ('off', 'none')) AS t(key, value)")
def config_lookup(spark, sf_dir):
    text = '{"bits": 3, "quantizer": {"clip": {"value": true, "status": "enabled"}}, "tree": {"depth": {"value": 9}}, "off": {"value": 1, "status": "disabled"}}'
    got = config.load(text, bits="none", clip="none", depth="none", missing="none", off="none")
    return spark.createDataFrame([(k, str(v).lower()) for k, v in got.items()], "key string, value string")


# --- the packed format ---------------------------------------------------------------

PACKED = f"{ONE}, k AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS pos, k AS l FROM kb)"


def _packed(spark, sf_dir) -> str:
    path = scratch(spark, "packed")
    packed.write(unique(spark, sf_dir), path, "label", NAMES, 2, ["row_id"], 7000)
    return path


@query(f"WITH {PACKED} SELECT pos AS row_id, l AS label, bin_0, bin_1, bin_2, bin_3 FROM k")
def packed_round_trip(spark, sf_dir):
    """Bit-packed files of bounded rows, written and read by tasks, in order of the row."""
    got = packed.read(spark, _packed(spark, sf_dir), 2, 3000)
    return got.select("row_id", "label", *[F.col("bins")[i].cast("int").alias(f"bin_{i}") for i in range(4)])


@query(f"WITH {PACKED} SELECT l AS label, [0, 0, 1, 3][bin_0 + 1] AS bin_0, [3, 2, 1, 0][bin_3 + 1] AS bin_3, count(*) AS n FROM k GROUP BY ALL")
def packed_remap(spark, sf_dir):
    """A change of bins that is still due is made as the rows are read."""
    got = packed.read(spark, _packed(spark, sf_dir), 2, remap={0: [0, 0, 1, 3], 3: [3, 2, 1, 0]})
    return got.groupBy("label", F.col("bins")[0].cast("int").alias("bin_0"), F.col("bins")[3].cast("int").alias("bin_3")).agg(F.count("*").alias("n"))


@query(f"WITH {BINS} SELECT cast(length(label) AS int) AS label, bin_0, bin_1, bin_2, bin_3, count(*) AS n FROM b GROUP BY ALL")
def packed_table_function(spark, sf_dir):
    """Bodies of packed rows, made by expressions, decoded by the SQL table function."""
    packed.register_decoder(spark)
    word = sum((F.col(f"bin_{i}") * (4**i) for i in range(1, 4)), F.col("bin_0"))
    body = F.to_binary(F.concat(F.lit("01"), F.lpad(F.hex(word), 2, "0")), F.lit("hex"))
    binned(spark, sf_dir).select(body.alias("body")).createOrReplaceTempView("packed_bodies")
    got = spark.sql("SELECT label, bins FROM packed_bodies, LATERAL unpack_rows(body, 4, 2)")
    return got.groupBy("label", *[F.col("bins")[i].cast("int").alias(f"bin_{i}") for i in range(4)]).agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('data', true), ('quantizer', true), ('forest', false), ('params', false), ('config', false), ('predictor', false), ('log', false), ('can_infer', false), ('can_train', true)) AS t(part, there)")
def artefact_scan(spark, sf_dir):
    folder = scratch(spark, "model")
    quantizer.fit(table(spark, sf_dir, "orders"), ["o_totalprice"]).save(spark, f"{folder}/quantizer")
    spark.range(3).write.parquet(f"{folder}/data")
    return spark.createDataFrame(list(artefacts.scan(spark, folder).items()), "part string, there boolean")


# --- pictures ---------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, cast((77 * (((w >> 11) & 31) << 3 | (((w >> 11) & 31) >> 2)) + 150 * (((w >> 5) & 63) << 2 | (((w >> 5) & 63) >> 4)) + 29 * ((w & 31) << 3 | ((w & 31) >> 2))) >> 8 AS BIGINT) AS grey FROM (SELECT *, (l_partkey * 7919 + l_orderkey) % 65536 AS w FROM lineitem)")
def grayscale_rgb565(spark, sf_dir):
    w = (F.col("l_partkey") * 7919 + F.col("l_orderkey")) % 65536
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", images.grey_rgb565(w).cast("long").alias("grey"))


@query(f"WITH {PIXELS}, {GREY} SELECT vec_id, (y * 8 + x) // 2 AS i, g AS v FROM q WHERE (y * 8 + x) % 2 = 0")
def grayscale_yuv422(spark, sf_dir):
    df = pictures(spark, sf_dir).select("vec_id", images.grey_yuv422(F.col("image")).alias("a"))
    return df.select("vec_id", F.posexplode("a").alias("i", "v")).select("vec_id", F.col("i").cast("long").alias("i"), "v")


@query(f"WITH {PIXELS}, {GREY}, t AS (SELECT p.vec_id, label, row_number() OVER (PARTITION BY label ORDER BY lpad(cast(p.vec_id AS varchar), 8, '0')) AS r FROM (SELECT DISTINCT vec_id FROM p) p JOIN embeddings USING (vec_id)) SELECT q.vec_id, cast(label AS varchar) AS class, cast(sum(g * (y * 8 + x + 1)) AS BIGINT) AS checksum FROM q JOIN t USING (vec_id) WHERE r <= 5 GROUP BY ALL")
def image_folder(spark, sf_dir):
    """PNG files by class, written by tasks and decoded by Spark's image source, five a class."""
    folder = scratch(spark, "pictures")
    rows = pictures(spark, sf_dir).select(F.col("label").alias("class"), F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("name"), "image")
    folders.write_images(rows, folder, 8, 8)
    got = folders.read_images(spark, folder, 8, 8, per_class=5)
    total = F.aggregate(F.transform("image", lambda v, i: (v * (i + 1)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return got.select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("vec_id"), "class", total.alias("checksum"))


@query(f"WITH {PIXELS}, {GREY}, t AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) SELECT cast(label AS varchar) AS class, count(DISTINCT q.vec_id) AS n, cast(sum(g) AS BIGINT) AS total FROM q JOIN t USING (vec_id) WHERE r <= 20 GROUP BY ALL")
def text_images(spark, sf_dir):
    """C arrays as text files by class; those of a wrong size are left out."""
    folder = scratch(spark, "arrays")
    nth = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    rows = pictures(spark, sf_dir).withColumn("nth", nth).where("nth <= 20")
    body = F.concat(F.lit("const uint8_t img[64] = { "), F.array_join(F.transform("image", lambda v: v.cast("string")), ", "), F.lit(" };"))
    torn = rows.where("nth = 1").select("label", (F.col("vec_id") + 1_000_000).alias("vec_id"), F.lit("img[] = {1, 2}").alias("body"))
    rows.select("label", "vec_id", body.alias("body")).unionByName(torn).repartition("vec_id").select("label", "body").write.partitionBy("label").option("maxRecordsPerFile", 1).option("lineSep", "\n").text(folder)
    got = folders.read_text_images(spark, folder, 64)
    total = F.aggregate("image", F.lit(0).cast("long"), lambda a, x: a + x)
    return got.groupBy(F.replace("class", F.lit("label="), F.lit("")).alias("class")).agg(F.count("*").alias("n"), F.sum(total).alias("total"))


@query(f"WITH {PIXELS}, {GREY}, c AS (SELECT vec_id, y, x, (77 * g + 150 * (255 - g) + 29 * (g // 2)) >> 8 AS v FROM q) SELECT vec_id, ty * 4 + tx AS i, cast(v AS int) AS v FROM c JOIN (SELECT unnest(range(4)) AS ty) ON y = ty * 2 JOIN (SELECT unnest(range(4)) AS tx) ON x = tx * 2")
def image_pipeline(spark, sf_dir):
    """Colour bytes to grey, resized to half the size."""
    raw = F.flatten(F.transform("image", lambda g: F.array(g, 255 - g, F.floor(g / 2).cast("int"))))
    df = pictures(spark, sf_dir).select("vec_id", images.pipeline(raw, 8, 8, "rgb888", 4, 4).alias("a"))
    return df.select("vec_id", F.posexplode("a").alias("i", "v")).select("vec_id", F.col("i").cast("long").alias("i"), F.col("v").cast("int").alias("v"))


@query("SELECT * FROM (VALUES ('qvga', 'rgb565', 153600, 76800), ('vga', 'grayscale', 307200, 307200), ('96x96', 'rgb888', 27648, 9216), ('cif', 'yuv422', 236800, 118400)) AS t(frame, form, input, grey)")
def image_config(spark, sf_dir):
    rows = []
    for frame, form in (("qvga", "rgb565"), ("vga", "grayscale"), ("96x96", "rgb888"), ("cif", "yuv422")):
        sizes = images.check_config(*images.FRAMES[frame], form, 32, 32)
        rows.append((frame, form, sizes["input"], sizes["grey"]))
    return spark.createDataFrame(rows, "frame string, form string, input int, grey int")


# --- functions ---------------------------------------------------------------------------

TWO64 = "18446744073709551616::HUGEINT"


def _signed(x: str) -> str:
    return f"cast(CASE WHEN {x} >= 9223372036854775808 THEN {x}::HUGEINT - {TWO64} ELSE {x} END AS BIGINT)"


def _times(x: str, k: int) -> str:
    return f"(({x}::HUGEINT * {k & 0xFFFFFFFF} + (({x}::HUGEINT * {k >> 32}) % 4294967296) * 4294967296) % {TWO64})::UBIGINT"


BYTES_OF = "list_transform(range(1, length(s) + 1), lambda i: ascii(s[i]))"


@query(f"""
SELECT p_partkey, {_signed(f"list_reduce(list_concat([{hashing.FNV_OFFSET}::UBIGINT], list_transform({BYTES_OF}, lambda b: b::UBIGINT)), lambda h, b: {_times('xor(h, b)', hashing.FNV_PRIME)})")} AS fnv1a,
{_signed(f"list_reduce(list_concat([5381::UBIGINT], list_transform({BYTES_OF}, lambda b: b::UBIGINT)), lambda h, b: xor({_times('h', 33)}, b))")} AS djb2 FROM (SELECT p_partkey, p_name AS s FROM part)
""")
def string_hashes(spark, sf_dir):
    b = hashing.octets(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", hashing.fnv1a(b).alias("fnv1a"), hashing.djb2(b).alias("djb2"))


def _mixed(x: str) -> str:
    """splitmix64 of an unsigned SQL expression, as nested sub-queries would say it."""
    return f"(SELECT xor(c, c >> 31) FROM (SELECT {_times('xor(b, b >> 27)', hashing.MIX_3)} AS c FROM (SELECT {_times('xor(a, a >> 30)', hashing.MIX_2)} AS b FROM (SELECT (({x}::HUGEINT + {hashing.MIX_1}) % {TWO64})::UBIGINT AS a))))"


@query(f"SELECT o_orderkey, {_signed('m')} AS mixed FROM (SELECT o_orderkey, {_mixed('o_orderkey')} AS m FROM orders)")
def splitmix(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", hashing.splitmix64(F.col("o_orderkey").cast("long")).alias("mixed"))


STEP = f"((((s::HUGEINT * {hashing.PCG_MULTIPLIER & 0xFFFFFFFF} + ((s::HUGEINT * {hashing.PCG_MULTIPLIER >> 32}) % 4294967296) * 4294967296) % {TWO64}) + inc) % {TWO64})::UBIGINT"


@query(f"""
WITH RECURSIVE k AS (SELECT p_partkey AS id, p_partkey::UBIGINT AS seed, (p_partkey * 2 + 1)::UBIGINT AS inc FROM part WHERE p_partkey < 200),
r(id, n, s, inc) AS (SELECT id, 0, (((inc::HUGEINT + seed) % {TWO64}))::UBIGINT, inc FROM k UNION ALL SELECT id, n + 1, {STEP}, inc FROM r WHERE n < 4),
o AS (SELECT id, n, (xor(s >> 18, s) >> 27) & 4294967295 AS x, (s >> 59)::INT AS t FROM r WHERE n > 0) SELECT id, n AS place, cast(((x >> t) | (x << ((32 - t) % 32))) & 4294967295 AS BIGINT) AS v FROM o
""")
def pcg_draws(spark, sf_dir):
    df = table(spark, sf_dir, "part").where("p_partkey < 200").select(F.col("p_partkey").cast("long").alias("id"))
    got = df.select("id", F.posexplode(hashing.pcg32(F.col("id"), F.col("id"), 4)).alias("place", "v"))
    return got.select("id", (F.col("place") + 1).alias("place"), "v")


@query(f"""
WITH {BAGS}, each AS (SELECT tree_id, row FROM bags, (SELECT unnest(range(1, 9)) AS k) WHERE k <= weight AND row < 300), ids AS (SELECT tree_id, list(row ORDER BY row) AS l FROM each GROUP BY 1),
octets AS (SELECT tree_id, list_concat(flatten(list_transform(l, lambda v: list_transform([0, 8, 16, 24], lambda s: (v >> s) & 255))), list_transform([0, 8, 16, 24, 32, 40, 48, 56], lambda s: (len(l) >> s) & 255)) AS b FROM ids)
SELECT tree_id, {_signed(f"list_reduce(list_concat([{hashing.FNV_OFFSET}::UBIGINT], list_transform(b, lambda x: x::UBIGINT)), lambda h, x: {_times('xor(h, x)', hashing.FNV_PRIME)})")} AS bag_hash FROM octets
""")
def bag_hashes(spark, sf_dir):
    bags = sampling.bootstrap(table(spark, sf_dir, "embeddings").count(), 5, spark, cap=8).where("row < 300")
    ids = bags.select("tree_id", F.explode(F.array_repeat("row", F.col("weight").cast("int"))).alias("row"))
    return ids.groupBy("tree_id").agg(hashing.hash_ids(F.collect_list("row")).alias("bag_hash"))


@query(f"WITH d AS (SELECT o_orderkey, row_number() OVER (ORDER BY {draw_sql('o_orderkey', 3)}, o_orderkey) AS r FROM orders) SELECT o_orderkey FROM d WHERE r <= 500")
def distinct_sample(spark, sf_dir):
    return sampling.distinct_sample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 500, 3)


@query(f"SELECT o_orderkey, row_number() OVER (ORDER BY {draw_sql('o_orderkey', 3)} % 1024, {draw_sql('o_orderkey', 3)}, o_orderkey) - 1 AS place FROM orders")
def shuffle_rows(spark, sf_dir):
    return sampling.shuffled(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 3)


BASKET = "a AS (SELECT l_orderkey AS id, list(l_partkey % 20 ORDER BY l_linenumber, l_partkey % 20) AS v FROM lineitem GROUP BY 1)"


def _baskets(spark, sf_dir) -> DataFrame:
    v = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 20).alias("v")))), lambda x: x["v"])
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(v.alias("v"))


def _said(x) -> F.Column:
    return F.array_join(F.transform(x, lambda v: v.cast("string")), ",")


def _say(x: str) -> str:
    return f"coalesce(array_to_string({x}, ','), '')"


@query(f"WITH {BASKET} SELECT id, {_say('list_sort(v)')} AS sorted, {_say('list_concat(v[1:1], [99], v[2:])')} AS inserted, {_say('list_concat(v[1:1], v[3:])')} AS erased, {_say('list_concat(v[1:5], list_transform(range(greatest(5 - len(v), 0)), lambda i: -1))')} AS resized, v[1] AS front, v[-1] AS back, {_say('list_transform(v, lambda x: x * 2)')} AS doubled FROM a")
def array_functions(spark, sf_dir):
    v = F.col("v")
    return _baskets(spark, sf_dir).select("id", _said(F.array_sort(v)).alias("sorted"), _said(containers.insert_at(v, 1, F.lit(99).cast("long"))).alias("inserted"), _said(containers.erase_at(v, 1)).alias("erased"), _said(containers.resize(v, 5, F.lit(-1).cast("long"))).alias("resized"), containers.front(v).alias("front"), containers.top(v).alias("back"), _said(F.transform(v, lambda x: x * 2)).alias("doubled"))


@query(f"WITH {BASKET} SELECT id, {_say('v[1:-2]')} AS popped, {_say('v[2:]')} AS dequeued, {_say('list_concat(v, [7])[-3:]')} AS bounded, {_say('list_concat([7], v)')} AS pushed FROM a")
def stacks_and_queues(spark, sf_dir):
    v, seven = F.col("v"), F.lit(7).cast("long")
    return _baskets(spark, sf_dir).select("id", _said(containers.pop(v)).alias("popped"), _said(containers.dequeue(v)).alias("dequeued"), _said(containers.push(v, seven, 3)).alias("bounded"), _said(containers.push_front(v, seven)).alias("pushed"))


@query(f"WITH {BASKET} SELECT id, {_say('list_sort(list_distinct(list_concat(v, [7])))')} AS items, list_contains(v, 7) AS found, CASE WHEN list_contains(v, 7) THEN 1 ELSE 100 END AS kept, 100 AS assigned, CASE WHEN list_contains(v, 7) THEN len(list_distinct(v)) - 1 ELSE len(list_distinct(v)) END AS left_over FROM a")
def sets_and_maps(spark, sf_dir):
    """Insert keeps what is there, assignment replaces, erase removes."""
    v, seven = F.col("v"), F.lit(7).cast("long")
    m = F.map_from_arrays(F.array_distinct(v), F.transform(F.array_distinct(v), lambda _: F.lit(1)))
    value = lambda x: F.element_at(x, seven)
    return _baskets(spark, sf_dir).select("id", _said(F.array_sort(containers.set_insert(F.array_distinct(v), seven))).alias("items"), F.map_contains_key(m, seven).alias("found"), value(containers.map_insert(m, seven, F.lit(100))).alias("kept"), value(containers.map_assign(m, seven, F.lit(100))).alias("assigned"), F.size(containers.map_erase(m, seven)).cast("long").alias("left_over"))


@query(f"WITH {BASKET} SELECT id, {_say('list_transform(v, lambda x: least(x, 7))')} AS narrow, {_say('list_transform(v, lambda x: least(x, 3))')} AS narrower, list_transform(v, lambda x: least(x, 7)) = list_transform(v, lambda x: least(x, 15)) AS same FROM a")
def packed_arrays(spark, sf_dir):
    """Values saturate at the width they are packed in; a change of width packs them again."""
    v, n = F.col("v"), F.size("v")
    narrow = containers.packed_words(v, 3)
    back = containers.unpacked(narrow, 3, n)
    wide = containers.unpacked(containers.packed_words(v, 4), 4, n)
    return _baskets(spark, sf_dir).select("id", _said(back).alias("narrow"), _said(containers.unpacked(containers.repacked(narrow, 3, 2, n), 2, n)).alias("narrower"), (back == wide).alias("same"))


@query("SELECT p_partkey, p_name || '.csv' AS base, upper(p_name) AS upper_name, CASE WHEN p_brand LIKE 'Brand#%' THEN substr(p_brand, 7) ELSE p_brand END AS brand, TRY_CAST(trim(p_brand) AS double) IS NOT NULL AS numeric FROM part")
def string_functions(spark, sf_dir):
    path = F.concat(F.lit("/data\\sets/"), "p_brand", F.lit("/"), "p_name", F.lit(".csv"))
    return table(spark, sf_dir, "part").select("p_partkey", containers.basename(path).alias("base"), F.upper("p_name").alias("upper_name"), containers.without_prefix(F.col("p_brand"), "Brand#").alias("brand"), F.trim("p_brand").try_cast("double").isNotNull().alias("numeric"))


@query(f"WITH {SETS}, m AS (SELECT coalesce(a.id, r.id) AS id, least(coalesce(ca, 0) + (r.id IS NOT NULL)::int, 3) AS cnt FROM a FULL JOIN (SELECT unnest(range(100, 201)) AS id) r ON a.id = r.id) SELECT id, cnt - (id IN (150, 160))::int AS cnt FROM m WHERE cnt - (id IN (150, 160))::int > 0")
def idset_ranges(spark, sf_dir):
    more = idset.insert_range(_sets(spark, sf_dir)[0], 100, 200, 3)
    return idset.erase_one(more, [150, 160])


@query(f"WITH {SETS}, e AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS p FROM a, (SELECT unnest([1, 2, 3]) AS k) WHERE k <= ca) SELECT id FROM e WHERE p = 500")
def idset_nth(spark, sf_dir):
    return idset.nth(_sets(spark, sf_dir)[0], 500)


FILLED = "SELECT unnest(range(10, 20)) AS id, 2::BIGINT AS cnt"


@query(f"SELECT * FROM ({FILLED}) WHERE id NOT IN (12, 13) AND id NOT BETWEEN 17 AND 18")
def idset_fill(spark, sf_dir):
    return idset.without(idset.fill(spark, 10, 19, 2), [12, 13], 17, 18)


HASHED = f"u AS (SELECT idx, CASE WHEN idx < 300 THEN 0.0e0 ELSE least(1.0e0, (idx - 300) / 500.0e0) END AS p, " + ", ".join(f"{uniform_sql('idx', 42 + 11 * j)} AS u{j}" for j in range(3)) + " FROM (SELECT unnest(range(1500)) AS idx))"


def _hash_step(h: str, j: int) -> str:
    sign = "" if j % 2 == 0 else "-"
    return f"xor({h}, (((CASE WHEN c{j} < 0 THEN c{j}::HUGEINT + {TWO64} ELSE c{j}::HUGEINT END) + 2654435769 + ({h}::HUGEINT * 64) % {TWO64} + ({h} >> 2)) % {TWO64})::UBIGINT)", sign


X = ", ".join(f"(u{j} - 0.5) * 20 + p * 1.0 * 5.0 * ({1 if j % 2 == 0 else -1}) AS x{j + 1}" for j in range(3))
C = ", ".join(f"cast(trunc((x{j + 1} + p * 5.0 * ({1 if j % 2 == 0 else -1})) * 1000) AS BIGINT) AS c{j}" for j in range(3))


@query(f"WITH {HASHED}, x AS (SELECT idx, p, {X} FROM u), c AS (SELECT *, {C} FROM x), h1 AS (SELECT *, {_hash_step('0::UBIGINT', 0)[0]} AS h FROM c), h2 AS (SELECT * EXCLUDE h, {_hash_step('h', 1)[0]} AS h FROM h1), h3 AS (SELECT * EXCLUDE h, {_hash_step('h', 2)[0]} AS h FROM h2) SELECT idx, round(x1, 6) AS x1, round(x2, 6) AS x2, round(x3, 6) AS x3, cast(h % 4 AS int) AS label FROM h3")
def drift_generator_hash(spark, sf_dir):
    o = drift.DriftOptions(boundary="hash", rows=1500, burn_in=300, width=500, features=3, labels=4)
    return drift.generate(spark, o).select("idx", *[F.round(f"x{j}", 6).alias(f"x{j}") for j in (1, 2, 3)], "label")


NOISY = f"n AS (SELECT idx, p, u0, u1, {uniform_sql('idx', 143)} AS flip, " + ", ".join(f"sqrt(-2 * ln(greatest({uniform_sql('idx', 243 + 2 * j)}, 1e-12))) * cos(2 * pi() * {uniform_sql('idx', 244 + 2 * j)}) AS z{j}" for j in (0, 1)) + f", {uniform_sql('idx', 343)} AS r0 FROM u)"


@query(f"WITH {UNIFORMS}, {NOISY}, x AS (SELECT *, (u0 - 0.5) * 20 AS x1, (u1 - 0.5) * 20 AS x2 FROM n), l AS (SELECT *, CASE WHEN x1 * cos(p * pi()) - x2 * sin(p * pi()) >= 0 THEN 0 ELSE 1 END AS k FROM x) SELECT idx, round(x1 * (1 + z0 * 0.02e0), 5) AS x1, round(x2 * (1 + z1 * 0.02e0), 5) AS x2, round((r0 - 0.5) * 20, 5) AS x3, cast(CASE WHEN flip < 0.1 THEN 1 - k ELSE k END AS int) AS label FROM l")
def drift_generator_noise(spark, sf_dir):
    o = drift.DriftOptions(rows=6000, burn_in=1000, width=2000, noise=0.1, feature_noise=0.02, redundant=1)
    return drift.generate(spark, o).select("idx", *[F.round(f"x{j}", 5).alias(f"x{j}") for j in (1, 2, 3)], "label")


# --- streams -------------------------------------------------------------------------------


@query("WITH w AS (SELECT epoch_us(ts) // 900000000 * 900000000 AS start FROM events) SELECT start, count(*) AS n FROM w GROUP BY 1")
def streaming_tumbling(spark, sf_dir):
    from quantgrove.streaming import jobs

    got = jobs.windowed(event_stream(spark, sf_dir), "ts", "10 minutes", "15 minutes")
    return _run_stream(got.select(F.unix_micros("window.start").alias("start"), "n"), spark, "complete")


@query("WITH g AS (SELECT user_id, epoch_us(ts) AS u, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events), s AS (SELECT user_id, u, sum(CASE WHEN gap IS NULL OR gap >= 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY u) AS s FROM g) SELECT user_id, min(u) AS start, count(*) AS n FROM s GROUP BY user_id, s")
def streaming_sessions(spark, sf_dir):
    from quantgrove.streaming import jobs

    got = jobs.windowed(event_stream(spark, sf_dir), "ts", "10 minutes", "", gap="2 hours", keys=["user_id"])
    return _run_stream(got.select("user_id", F.unix_micros("window.start").alias("start"), "n"), spark, "complete")


PER_USER = "c AS (SELECT user_id % 8 AS u, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) - 1 AS pos, (value >= 50)::int AS hit FROM events)"


@query(f"WITH {PER_USER}, t AS (SELECT u, pos, avg(hit) OVER (PARTITION BY u ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS a FROM c) SELECT u AS user_group, pos AS \"at\", round(a, 6) AS accuracy FROM t WHERE pos >= 19 AND (pos + 1) % 10 = 0")
def streaming_count_window(spark, sf_dir):
    """Windows of counts as state: the last twenty rows of a key at every tenth row."""
    from quantgrove.streaming import jobs

    rows = event_stream(spark, sf_dir).select((F.col("user_id") % 8).alias("user_group"), F.col("event_id").alias("seq"), F.col("actual").alias("correct"))
    return _run_stream(jobs.trailing_accuracy_stream(rows, "user_group", 20), spark).withColumn("accuracy", F.round("accuracy", 6))


@query("""
WITH e AS (SELECT user_id % 8 AS u, event_id, event_id % 2 = 0 AS p, CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id % 3 END AS a FROM events),
r AS (SELECT *, sum(CASE WHEN p THEN 1 ELSE -1 END) OVER (PARTITION BY u ORDER BY event_id) AS s FROM e), m AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY u ORDER BY event_id)) AS waiting FROM r),
k AS (SELECT *, waiting - CASE WHEN p THEN 1 ELSE 0 END AS before, lag(waiting, 1, 0) OVER (PARTITION BY u ORDER BY event_id) AS had FROM m),
pn AS (SELECT u, event_id, row_number() OVER (PARTITION BY u ORDER BY event_id) AS i FROM k WHERE p), an AS (SELECT u, a, row_number() OVER (PARTITION BY u ORDER BY event_id) AS i FROM k WHERE NOT p AND had > 0)
SELECT u AS user_group, cast(pn.event_id % 1000 AS int) AS predicted, cast(a AS int) AS actual FROM pn JOIN an USING (u, i) WHERE a IS NOT NULL
""")
def streaming_feedback(spark, sf_dir):
    """Labels meet the oldest prediction that waits; labels without one are dropped, and so are pairs with an unknown label."""
    from quantgrove.streaming import jobs

    kind = F.when(F.col("event_id") % 2 == 0, "prediction").otherwise("label")
    value = F.when(kind == "prediction", F.col("event_id") % 1000).when(F.col("user_id") % 5 != 0, F.col("user_id") % 3).cast("int")
    rows = event_stream(spark, sf_dir).select((F.col("user_id") % 8).alias("user_group"), F.col("event_id").alias("seq"), kind.alias("kind"), value.alias("value"))
    return _run_stream(jobs.pair_feedback(rows, "user_group", 1_000_000), spark)


@query(f"WITH {BINS}, v AS (SELECT row_id, CASE WHEN bin_0 <= 1 THEN CASE WHEN bin_1 <= 0 THEN 0 ELSE 1 END ELSE 2 END AS a, CASE WHEN bin_2 <= 2 THEN 1 WHEN bin_3 <= 1 THEN 0 ELSE 2 END AS d, CASE WHEN bin_1 > 2 THEN 1 WHEN bin_0 <= 0 THEN 2 WHEN bin_3 <= 0 THEN 0 ELSE 1 END AS e FROM b), p AS (SELECT row_id, CASE WHEN a = d OR a = e THEN a WHEN d = e THEN d ELSE least(a, d, e) END AS k FROM v) SELECT k AS predicted, ['A', 'N'][k + 1] AS label, k < 2 AS success, count(*) AS n FROM p GROUP BY ALL")
def predict_and_decode(spark, sf_dir):
    """Quantise, vote, decode: the third class has no name here, so its rows don't succeed."""
    from quantgrove.streaming import jobs

    names = spark.createDataFrame([("A", 0), ("N", 1)], "label string, label_id int")
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    got = jobs.predict_one(rows, _quantizer(spark, sf_dir), FIXED, 3, names)
    return got.groupBy("predicted", "label", "success").agg(F.count("*").alias("n"))


@query(f"{HOG} SELECT vec_id, i, round(coalesce(v, 0) / (sqrt(sum(coalesce(v, 0) * coalesce(v, 0)) OVER (PARTITION BY vec_id, i // 4)) + 1e-6), 5) AS v FROM h")
def hog_single_cells(spark, sf_dir):
    """Blocks of one cell each."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", images.hog(F.col("embedding"), 8, 8, size=1).alias("a"))
    return df.select("vec_id", F.posexplode("a").alias("i", "v")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("v", 5).alias("v"))
