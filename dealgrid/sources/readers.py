"""Readers of registries, exports, snapshots, rate tables, activity batches and transcripts."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealgrid.functions import columns as fn
from dealgrid.operators.fx import load_rates
from dealgrid.session import cut_lineage, small_files, task_folder

RATE_CONVENTIONS = ("units-of-currency-per-base", "base-per-unit")

RATE_FEED = T.StructType([
    T.StructField("base", T.StringType()),
    T.StructField("convention", T.StringType()),
    T.StructField("rates", T.MapType(T.StringType(), T.DecimalType(18, 8))),
    T.StructField("source", T.StringType()),
    T.StructField("effective_from", T.DateType()),
])

ACTIVITY_BATCH = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("user_emails", T.ArrayType(T.StringType())),
    T.StructField("events", T.ArrayType(T.StructType([
        T.StructField("date", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("opp_id", T.StringType()),
        T.StructField("counterpart_email", T.StringType()),
        T.StructField("sender", T.StringType()),
        T.StructField("detail", T.StringType()),
    ]))),
])


def read_registry(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A hand-edited table under its declared schema; a broken line keeps its text in `_bad`. Quoted cells may hold line breaks."""
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    return (
        spark.read.schema(wide).option("header", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad").option("dateFormat", "yyyy-MM-dd").option("multiLine", True).option("escape", '"').csv(path)
    )


def _typed(raw: Column, kind: str) -> Column:
    if kind == "date":
        return fn.parse_mixed_date(raw)
    if kind == "boolean":
        return fn.parse_mixed_bool(raw)
    if kind == "money":
        return fn.parse_money(raw)
    if kind == "id":
        return fn.norm_record_id(raw)
    return raw if kind == "string" else raw.try_cast(kind)


def _cp1252(c: Column) -> Column:
    """Text read as ISO-8859-1 with the 27 characters that the Windows code page puts elsewhere."""
    moved = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    moved = [(a, b) for a, b in moved if b]
    return F.translate(c, "".join(a for a, _ in moved), "".join(b for _, b in moved))


def read_export(
    spark: SparkSession, path: str, columns: list[str], field_map: Mapping[str, tuple[str, str]], id_column: str,
    id_pattern: str = r"[A-Za-z0-9]{15}([A-Za-z0-9]{3})?",
) -> tuple[DataFrame, DataFrame]:
    """A report export with header labels; rows without a record id (totals footers) are kept apart.

    `columns` is the header in file order; `field_map` gives label -> (local name, kind); `id_pattern` is what the source's
    record ids look like. Quoted cells may hold line breaks, so a file is read by one task.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.schema(schema).option("header", True).option("encoding", "iso-8859-1").option("enforceSchema", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.select(*[_cp1252(F.col(f"`{c}`")).alias(c) for c in columns])
    has_id = F.trim(F.coalesce(F.col(f"`{id_column}`"), F.lit(""))).rlike(f"^({id_pattern})$")
    mapped = [_typed(F.col(f"`{label}`"), kind).alias(name) for label, (name, kind) in field_map.items()]
    return raw.filter(has_id).select(*mapped), raw.filter(~has_id)


def unmapped_columns(df: DataFrame, field_map: Mapping[str, object]) -> DataFrame:
    """Columns that no mapping covers, with the rows that would be lost."""
    loose = [c for c in df.columns if c not in field_map]
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(loose)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("non_null_rows")) for i, c in enumerate(loose)])
    return counts.select(F.explode(pairs).alias("p")).select("p.*")


def read_crm_snapshot(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_fx_rates(spark: SparkSession, path: str, convention: str = "units-of-currency-per-base") -> DataFrame:
    """Rate table published as a map per source and date, as multipliers to the base currency.

    Every row is turned by its own convention, and by `convention` where it names none; a row of an unknown convention has a null rate.
    """
    feed = spark.read.schema(RATE_FEED).json(path).withColumn("convention", F.coalesce("convention", F.lit(convention)))
    flat = feed.select(F.explode("rates").alias("currency", "units_per_base"), "source", "effective_from", "convention")
    known = [load_rates(flat.filter(F.col("convention") == c), c) for c in RATE_CONVENTIONS]
    other = flat.filter(~F.col("convention").isin(*RATE_CONVENTIONS)).select("currency", F.lit(None).cast("decimal(18,8)").alias("rate"), "source", "effective_from")
    return reduce(DataFrame.unionByName, [*known, other])


def explode_activity(batches: DataFrame) -> DataFrame:
    """Event rows of nested batches; direction from whether the sender is one of the user's own addresses."""
    events = batches.select("source", "user_emails", F.explode("events").alias("e"))
    mine = F.array_contains(F.transform("user_emails", lambda e: F.lower(e)), F.lower("e.sender"))
    direction = F.when(F.col("e.sender").isNull() | F.col("user_emails").isNull(), None).when(mine, "outbound").otherwise("inbound")
    return events.select(
        fn.parse_mixed_date(F.col("e.date")).alias("day"), F.col("e.kind").alias("kind"), F.col("e.opp_id").alias("opp_id"),
        F.lower("e.counterpart_email").alias("counterpart_email"), F.col("e.detail").alias("detail"),
        direction.alias("direction"), "source",
    )


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    return explode_activity(spark.read.schema(ACTIVITY_BATCH).json(path))


# A speaker: up to eight words of letters and digits of any script, the first of them a letter.
_SPEAKER = r"\p{L}[\p{L}\p{M}\p{N}.'\u2019()&/-]*(?: [\p{L}\p{M}\p{N}.'\u2019()&/-]+){0,7}"


def split_turns(texts: DataFrame) -> DataFrame:
    """Speaker turns of whole transcripts: a line `Name: words` starts a turn."""
    parts = F.split(F.col("value"), rf"\n(?={_SPEAKER}: )")
    turns = texts.select("raw_path", F.posexplode(parts).alias("turn", "_part"))
    head = rf"(?s)^({_SPEAKER}): (.*)$"
    return turns.select(
        F.regexp_extract("raw_path", r"([^/]+)\.[a-z]+$", 1).alias("meeting_id"), "turn",
        F.nullif(F.regexp_extract("_part", head, 1), F.lit("")).alias("speaker"),
        F.when(F.col("_part").rlike(head), F.regexp_extract("_part", head, 2)).otherwise(F.col("_part")).alias("text"),
        "raw_path",
    )


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """The turns of all transcripts below a folder, a file each; read once, many files to a task."""
    texts = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).withColumn("raw_path", F.input_file_name())
    with small_files(spark):
        return cut_lineage(split_turns(texts), "transcript-turns")


def repair_registry(df: DataFrame, kinds: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Undo what spreadsheets do to typed cells; columns the user added pass through.

    Returns the typed registry and one row per column: cells whose text had to change, and cells
    that could not be read at all.
    """
    fixed = {c: _typed(F.col(c), kind) for c, kind in kinds.items()}
    out = df.select(*[fixed[c].alias(c) if c in fixed else F.col(c) for c in df.columns])
    counts, cells = [], []
    for i, (c, value) in enumerate(fixed.items()):
        filled = F.col(c).isNotNull() & (F.trim(F.col(c)) != "")
        counts.append(F.count_if(filled & value.isNotNull() & (value.cast("string") != F.col(c))).alias(f"r{i}"))
        counts.append(F.count_if(filled & value.isNull()).alias(f"u{i}"))
        cells.append(F.struct(F.lit(c).alias("column"), F.col(f"r{i}").alias("repaired"), F.col(f"u{i}").alias("unreadable")))
    report = df.agg(*counts).select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return out, report


def _hash_blocks(batches):
    """sha-256 of each file, read in blocks from the shared file system."""
    import hashlib

    import pandas as pd
    from pyarrow import fs

    for pdf in batches:
        digests = []
        for path in pdf["path"]:
            system, inner = fs.FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with system.open_input_stream(inner) as stream:
                while block := stream.read(1 << 20):
                    digest.update(block)
            digests.append(digest.hexdigest())
        yield pd.DataFrame({"path": pdf["path"], "bytes": pdf["length"], "sha256": digests})


#: Folders that a task lists; files and bytes that a task hashes, about.
FOLDERS_PER_TASK, FILES_PER_TASK, BYTES_PER_TASK = 1000, 4000, 128 << 20


def _lister(uri: str):
    """What lies in each folder `rel` below `uri`: rel, and bytes, which a folder hasn't. What Spark's readers take for hidden or empty is left out."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(uri)
        kinds, root = (fs.FileType.File, fs.FileType.Directory), root.rstrip("/") + "/"
        hidden = lambda n: n.startswith(".") or n.startswith("_") and "=" not in n or n.endswith("._COPYING_")
        kept = lambda x: x.type == kinds[1] and x.base_name.startswith(("_metadata", "_common_metadata"))
        shown = lambda x: x.type in kinds and x.size != 0 and (kept(x) or not hidden(x.base_name))
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array([x.path[len(root):] for x in rows], pa.string()), pa.array([x.size for x in rows], pa.int64())], ["rel", "bytes"])
        rows = []
        for batch in batches:
            for rel in batch.column(0).to_pylist():
                rows += filter(shown, system.get_file_info(fs.FileSelector(root + rel)))
                while len(rows) >= 10_000:
                    yield out(rows[:10_000])
                    del rows[:10_000]
        yield out(rows)

    return run


def _hasher(uri: str):
    """sha-256 and size of each file `rel` below `uri`, read in blocks."""

    def run(batches):
        import hashlib

        import pyarrow as pa
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(uri)
        root = root.rstrip("/") + "/"
        for batch in batches:
            names, digests, sizes = batch.column(0).to_pylist(), [], []
            for rel in names:
                digest, size = hashlib.sha256(), 0
                with system.open_input_stream(root + rel) as stream:
                    while block := stream.read(1 << 20):
                        digest.update(block)
                        size += len(block)
                digests.append(digest.hexdigest())
                sizes.append(size)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(digests, pa.string()), pa.array(sizes, pa.int64())], ["rel", "sha256", "bytes"])

    return run


def _hashed_in_tasks(spark: SparkSession, uri: str, pattern: str) -> DataFrame:
    """The files below a folder, listed level by level and hashed in blocks, all of it in tasks; the driver gets counts."""
    level, folders, files, size, found = spark.range(1).select(F.lit("").alias("rel")), 1, 0, 0, []
    while folders:
        listed = level.repartition(-(-folders // FOLDERS_PER_TASK), "rel").mapInArrow(_lister(uri), "rel string, bytes long")
        found.append(cut_lineage(listed, "listing"))
        level = found[-1].filter(F.col("bytes").isNull()).select("rel")
        folders, n, more = found[-1].agg(F.count_if(F.col("bytes").isNull()), F.count("bytes"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        files, size = files + n, size + more
    glob = spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
    owned = reduce(DataFrame.unionAll, found).filter(F.col("bytes").isNotNull() & F.substring_index("rel", "/", -1).rlike(rf"(?s)\A(?:{glob})\z"))
    tasks = 1 + files // FILES_PER_TASK + size // BYTES_PER_TASK
    return owned.select("rel").repartition(tasks, "rel").mapInArrow(_hasher(uri), "rel string, sha256 string, bytes long")


def content_manifest(spark: SparkSession, path: str, pattern: str = "*", in_memory: int = 64 << 20) -> DataFrame:
    """Path, size and content hash of every owned file below a folder.

    Folders and files that tasks can open are listed and read there, files in blocks: neither the driver nor a plan holds their names. Elsewhere Spark's reader lists them;
    small files are then hashed from the row that holds them, and the content of larger ones never enters a row. The large ones are picked by the sizes in the listing, so a
    small file is opened once, and many in a task.
    """
    if (uri := task_folder(spark, path)) is not None:
        return cut_lineage(_hashed_in_tasks(spark, uri, pattern), "manifest")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    small = files.filter(F.col("length") <= in_memory).select(
        "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = files.filter(F.col("_metadata.file_size") > in_memory).select("path", "length")
    blocks = large.mapInPandas(_hash_blocks, "path string, bytes long, sha256 string")
    # What follows the folder in the full path; the folder's name may hold any characters and may occur above it, too.
    root = "/" + path.rstrip("/").split("/")[-1] + "/"
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().toString()
    rel = F.when(F.startswith("path", F.lit(full + "/")), F.substring("path", len(full) + 2, 1 << 20)).otherwise(F.substring_index("path", root, -1))
    with small_files(spark):
        return cut_lineage(small.unionByName(blocks).select(rel.alias("rel"), "sha256", "bytes"), "manifest")
