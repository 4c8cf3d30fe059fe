"""Scans and sinks: datasets, id lists, rankings, archives, ledgers, logs, source trees, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

INSTANCE = "repo string, instance_id string, base_commit string, problem_statement string, created_at string, test_patch string, patch string, pull_number int, title string"
ENTITY = "struct<file_path:string,name:string,signature:string,source_code:string,doc_string:string,similarity:double,start_line:int,end_line:int,entity_type:string>"
RANKING = f"related_entities struct<methods:array<{ENTITY}>,classes:array<{ENTITY}>>"
ARCHIVE = f"instance_id string, top_k int, sources map<string,array<{ENTITY}>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_dataset(spark: SparkSession, path: str, schema: str = INSTANCE, array: bool = False) -> DataFrame:
    """JSON lines, or one array per file."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", array).json(path)


def only_ids(rows: DataFrame, ids: DataFrame, key: str = "instance_id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def normalise_dialect(rows: DataFrame) -> DataFrame:
    """Instances of the second dialect (org, repo, base.sha, body, fix_patch) in the columns of the first."""
    has = set(rows.columns)
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n.split(".")[0] in has], F.lit(None).cast("string"))
    repo = F.when(F.col("org").isNotNull(), F.concat_ws("/", "org", "repo")).otherwise(F.col("repo")) if "org" in has else F.col("repo")
    body = pick("problem_statement", *([] if "body" not in has else ["body"]))
    return rows.select("instance_id", repo.alias("repo"), pick("base_commit", "base.sha").alias("base_commit"), F.trim(F.concat_ws("\n", *(["title"] if "title" in has else []), body)).alias("problem_statement"), pick("patch", "fix_patch").alias("patch"))


def id_list(spark: SparkSession, path: str, key: str = "instance_id") -> DataFrame:
    """Ids, one a line or as JSON objects; blank lines and # comments are skipped."""
    line = F.trim("value")
    return spark.read.text(path).where((line != "") & ~line.startswith("#")).select(F.coalesce(F.get_json_object(line, f"$.{key}"), F.when(~line.startswith("{"), line)).alias(key)).where(F.col(key).isNotNull())


def ranking_folder(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file per instance: instance_id (file stem), rank, entity fields."""
    rows = spark.read.schema(RANKING).option("multiLine", True).json(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json(?:\.gz)?$", 1).alias("instance_id"), "related_entities.methods")
    return rows.select("instance_id", F.posexplode("methods").alias("at", "e")).select("instance_id", (F.col("at") + 1).alias("rank"), "e.*")


def ranking_archive(spark: SparkSession, path: str, source: str, limit: int) -> DataFrame:
    """First ``limit`` entities of one source of an archive of JSON lines (gz or plain)."""
    rows = spark.read.schema(ARCHIVE).json(path).select("instance_id", F.posexplode(F.slice(F.col("sources")[source], 1, limit)).alias("at", "e"))
    return rows.select("instance_id", (F.col("at") + 1).alias("rank"), "e.*")


def write_archive(rankings: DataFrame, path: str, top: int) -> None:
    """Rankings (instance_id, source, rank, ...) as one JSON line per instance, top entities only, compressed."""
    fields = [c for c in rankings.columns if c not in ("instance_id", "source")]
    lists = rankings.where(F.col("rank") <= top).groupBy("instance_id", "source").agg(F.array_sort(F.collect_list(F.struct(*(["rank"] + [f for f in fields if f != "rank"])))).alias("entities"))
    lines = lists.groupBy("instance_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "entities")))).alias("sources")).withColumn("top_k", F.lit(top))
    lines.select("instance_id", "top_k", "sources").write.mode("overwrite").json(path, compression="gzip")


def materialise_archive(spark: SparkSession, archive: str, path: str) -> None:
    """An archive as one folder per source."""
    rows = spark.read.schema(ARCHIVE).json(archive).select("instance_id", F.explode("sources").alias("source", "entities"))
    rows.write.mode("overwrite").partitionBy("source").json(path)


def file_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Ranked files of JSON lines; a file keeps its first entry, a missing rank is the position."""
    schema = "instance_id string, ranked_files array<struct<file_path:string,rank:int,support:int,first_entity_rank:int,graph_distance:int,direct_anchor:boolean>>"
    rows = spark.read.schema(schema).json(path).select("instance_id", F.posexplode("ranked_files").alias("at", "f"))
    first = F.row_number().over(Window.partitionBy("instance_id", "f.file_path").orderBy("at"))
    return rows.withColumn("n", first).where("n = 1").select("instance_id", F.col("f.file_path").alias("file"), F.coalesce("f.rank", F.col("at") + 1).alias("rank"), "f.support", "f.first_entity_rank", "f.graph_distance", "f.direct_anchor")


def localizer_output(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """External localisers: files in order, each with its list of location lines."""
    rows = spark.read.schema("instance_id string, found_files array<string>, found_related_locs map<string,array<string>>").json(path)
    files = rows.select("instance_id", F.posexplode("found_files").alias("file_at", "file"), "found_related_locs")
    lines = files.select("instance_id", "file_at", "file", F.posexplode_outer(F.flatten(F.transform(F.coalesce(F.col("found_related_locs")[F.col("file")], F.array().cast("array<string>")), lambda x: F.split(x, "\n")))).alias("at", "location"))
    place = F.regexp_extract_all("location", F.lit(r"^\s*(function|class|method|variable):\s*(\S+)"), F.lit(2))
    named = lines.select("instance_id", "file", "file_at", "at", F.try_element_at(place, F.lit(1)).alias("name")).where("name IS NOT NULL")
    return named.withColumn("rank", F.row_number().over(Window.partitionBy("instance_id").orderBy("file_at", "at"))).where(F.col("rank") <= limit)


def ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated ledger with a header; NA is null."""
    return spark.read.schema(schema).options(sep="\t", header=True, nullValue="NA", encoding="UTF-8").csv(path)


def write_ledger(df: DataFrame, path: str, columns: list[str], places: int = 6) -> None:
    """Tab-separated ledger: fixed column order, fixed decimals, NA for null and empty."""
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    cell = lambda c: F.format_string(f"%.{places}f", c) if c in doubles else F.col(c).cast("string")
    df.select(*[F.when(F.col(c).isNull() | (cell(c) == ""), "NA").otherwise(cell(c)).alias(c) for c in columns]).write.mode("overwrite").options(sep="\t", header=True, quote="").csv(path)


def source_tree(spark: SparkSession, root: str, glob: str = "*.py") -> DataFrame:
    """Files below a folder: path (below the root), content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    tail = root.rstrip("/").rsplit("/", 1)[-1]
    return files.select(F.regexp_replace("path", f"^.*?/{tail}/", "").alias("path"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("sha256"), "length")


def folders(files: DataFrame, path: str = "path") -> DataFrame:
    """(parent, child, child_is_file) links from every folder to what it holds; the root is '.'."""
    parts = F.split(F.col(path), "/")
    steps = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.when(k == 1, F.lit(".")).otherwise(F.array_join(F.slice(parts, F.lit(1), k - 1), "/")).alias("parent"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("child"), (k == F.size(parts)).alias("child_is_file")))).alias("s"))
    return steps.select("s.*").distinct()


def history_until(rows: DataFrame, cutoffs: DataFrame, key: str, time: str, most: int) -> DataFrame:
    """Newest ``most`` commits or tags of each key at or before its cutoff."""
    past = rows.join(cutoffs, key).where(F.col(time) <= F.col("cutoff"))
    return past.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(time).desc(), "id"))).where(F.col("n") <= most).drop("n")


def carried_log(spark: SparkSession, path: str, patterns: dict[str, str], record: str) -> DataFrame:
    """Log lines that match ``record``, with the last value seen before of every pattern (first group)."""
    lines = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("n", "line"))
    before = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = lambda p: F.try_element_at(F.regexp_extract_all("line", F.lit(p), F.lit(1)), F.lit(1))
    carried = lines.select("*", *[F.last(found(p), ignorenulls=True).over(before).alias(name) for name, p in patterns.items()])
    return carried.withColumn("record", found(record)).where("record IS NOT NULL")


def whole_file_fields(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """One row per file: the first group of each pattern."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.input_file_name().alias("file"), *[F.try_element_at(F.regexp_extract_all("value", F.lit(p), F.lit(1)), F.lit(1)).alias(n) for n, p in patterns.items()])


def cache_key(model: Column | str, revision: str, text: Column) -> Column:
    """Key of an embedding: SHA-256 of model@revision, a zero byte and the text."""
    model = F.lit(model) if isinstance(model, str) else model
    return F.sha2(F.concat(model, F.lit("@" + revision), F.decode(F.lit(b"\x00"), "UTF-8"), text), 256)


def cached_vectors(rows: DataFrame, path: str, embed, model: str, revision: str, text: str = "text") -> DataFrame:
    """``rows`` with a ``vector`` from the cache at ``path``; texts that it lacks are embedded once and appended to it.

    The cache is a Parquet table (key, vector). ``embed`` maps a DataFrame (key, text) to (key, vector). Null texts have no vector.
    """
    spark = rows.sparkSession
    schema = "key string, vector array<double>"
    known = lambda: spark.read.schema(schema).parquet(path)
    if not known_path(spark, path):
        spark.createDataFrame([], schema).write.parquet(path)
    keyed = rows.withColumn("key", cache_key(model, revision, F.col(text)))
    new = missing(keyed.where(F.col(text).isNotNull()).select("key", F.col(text).alias("text")).dropDuplicates(["key"]), known(), ["key"])
    embed(new).select("key", F.col("vector").cast("array<double>").alias("vector")).write.mode("append").parquet(path)
    return keyed.join(known().dropDuplicates(["key"]), "key", "left").select(*rows.columns, "vector")


def known_path(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the store that it names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def arrow_streams(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tables from Arrow IPC streams or files, one or more below ``path``: the columns of ``schema``, file by file on the executors."""
    import pyarrow as pa

    kind = T._parse_datatype_string(schema)
    names = [f.name for f in kind.fields]

    def run(batches):
        for b in batches:
            for content in b.column(0):
                data = content.as_buffer()
                whole = data.slice(0, 6).to_pybytes() == b"ARROW1"
                table = (pa.ipc.open_file(data) if whole else pa.ipc.open_stream(data)).read_all().select(names)
                yield from table.combine_chunks().to_batches(max_chunksize=10_000)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, kind)


def missing(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys no earlier output holds: what a resumed run still has to do."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def snapshot(df: DataFrame, path: str, by: list[str] = ()) -> None:
    """A table as Parquet, replaced as a whole or by partition."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if by else "static").partitionBy(*by).parquet(path)


def difference(whole: DataFrame, part: DataFrame, key: str) -> DataFrame:
    """Ids of one list that another lacks."""
    return whole.select(key).exceptAll(part.select(key))


def time_slices(start: Column, end: Column, days: int) -> Column:
    """Start and end of consecutive slices of at most ``days`` days, for connectors that limit a query's range."""
    step = F.expr(f"INTERVAL {days} DAYS")
    return F.transform(F.sequence(start, end, step), lambda s: F.struct(s.alias("start"), F.least(s + step, end).alias("end")))


def html_ticket(html: Column) -> Column:
    """title, text, reporter and created of a ticket page by its usual marks."""
    first = lambda p: F.try_element_at(F.regexp_extract_all(html, F.lit(p), F.lit(1)), F.lit(1))
    strip = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"\s+", " "))
    return F.struct(strip(first(r"(?s)<title>(.*?)</title>")).alias("title"), strip(first(r"(?s)<body[^>]*>(.*)</body>")).alias("text"), first(r'class="reporter"[^>]*>([^<]*)<').alias("reporter"), first(r'datetime="([^"]*)"').alias("created"))
