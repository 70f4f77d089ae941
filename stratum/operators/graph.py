"""Relations between files: calls resolved to files, degrees, closures, and files that change together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum import scratch
from stratum.functions import paths, text
from stratum.operators import shared
from stratum.schemas import EXTERNAL

# What an import without a suffix may mean, in order.
SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs", ".java", ".c", ".cpp"]
DIAGRAM_SUFFIXES = SUFFIXES[:9]
INDEX_FILES = ["index.ts", "index.js", "index.tsx"]


#: Lines of a bin of the joins of lines with ranges of lines.
BIN = 512


def shuffled(table: DataFrame) -> DataFrame:
    """The table as a side of a join that is shuffled and merged. Spark guesses a table's size by that of its files, so one that grows
    out of a few short rows passes for small, is broadcast, and takes all of the driver's memory."""
    return table.hint("merge")


def bins(first: Column, last: Column, size: int = BIN) -> Column:
    """A row for each bin that the lines meet; none for a range that ends before it begins."""
    low, high = F.floor(first / size).cast("int"), F.floor(last / size).cast("int")
    return F.explode(F.when(first <= last, F.sequence(low, high)))


def enclosing(calls: DataFrame, functions: DataFrame, size: int = BIN) -> DataFrame:
    """Adds caller_name to calls (file_path, line): the first function, by start and order, whose lines hold the line.

    Functions are dealt into bins of lines and cut to them. Of those that are cut to the same lines only the first can be
    an answer, so a bin holds a bounded list whatever is in a file, and a file of any length is many keys.
    """
    dealt = functions.select("file_path", "name", "start_line", "ord", "end_line", bins(F.col("start_line"), F.col("end_line"), size).alias("bin"))
    low, high = F.greatest("start_line", F.col("bin") * size), F.least("end_line", F.col("bin") * size + size - 1)
    first = dealt.groupBy("file_path", "bin", low.alias("low"), high.alias("high")).agg(F.min(F.struct("start_line", "ord", "end_line", "name")).alias("first"))
    spans = first.groupBy("file_path", "bin").agg(F.collect_list(F.struct("first", "low", "high")).alias("spans"))
    found = F.filter("spans", lambda s: (s.low <= F.col("line")) & (s.high >= F.col("line")))
    joined = calls.withColumn("bin", F.floor(F.col("line") / size).cast("int")).join(shuffled(spans), ["file_path", "bin"], "left")
    return joined.withColumn("caller_name", F.coalesce(F.array_min(F.transform(found, lambda s: s.first))["name"], F.lit("<module>"))).drop("spans", "bin")


def frequent(rows: DataFrame, keys: list[str], total: int, share: int = 1000, least: int = 500) -> DataFrame:
    """Keys that a ``share``-th of the ``total`` rows have, and ``least`` rows at any rate; so there are ``share`` of them at most."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= max(least, -(-total // share))).select(*keys)


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """``rows`` left joined with ``table``, which has a row a key. Rows of the ``hot`` keys stay where they are and get theirs by a
    broadcast; the others are shuffled by key, of which none has many rows then."""
    few = F.broadcast(hot.join(table.join(F.broadcast(hot), keys, "left_semi"), keys, "left"))
    rest = rows.join(F.broadcast(hot), keys, "left_anti").join(shuffled(table), keys, "left")
    return rows.join(few, keys).unionByName(rest)


def stem() -> Column:
    """What a relative import (file_path, source) means up to its suffix; null for any other."""
    folder = F.regexp_extract("file_path", r"^(.*/)[^/]*$", 1)
    return F.when(F.col("source").startswith("."), paths.normalized(F.concat(folder, F.col("source"))))


def endings(suffixes: list[str]) -> list[str]:
    """What may follow the stem of an import, in order."""
    return [*suffixes, *("/" + x for x in INDEX_FILES)]


def tries(suffixes: list[str]) -> Column:
    """What a relative import (file_path, source) may mean, in order; null for any other."""
    return F.transform(F.when(stem().isNotNull(), F.array(*map(F.lit, endings(suffixes)))), lambda x: F.concat(stem(), x))


def import_targets(imports: DataFrame, files: DataFrame, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """imports (file_path, source, ...) with ``target``, the file that a relative source means, or null.

    Each file says for which stems it stands, two or three, and in which place; of a stem's files the first counts. So an import is a
    row of one join, however many suffixes there are.
    """
    path = F.col("file_path")
    stands = F.array(*(F.when(path.endswith(x), F.struct(F.substr(path, F.lit(1), F.length(path) - len(x)).alias("_stem"), F.lit(i).alias("place"))) for i, x in enumerate(endings(suffixes))))
    known = files.select(path.alias("target"), F.explode(F.filter(stands, lambda x: x.isNotNull())).alias("s")).select("target", "s.*")
    best = known.groupBy("_stem").agg(F.min_by("target", "place").alias("target"))
    return imports.withColumn("_stem", stem()).join(shuffled(best), "_stem", "left").drop("_stem")


def resolved(calls: DataFrame, functions: DataFrame, imports: DataFrame, share: int = 1000, least: int = 500) -> DataFrame:
    """Adds callee_file to calls (caller_file, callee_name, ...): the caller's own file if it defines the name, else
    the file that the name is imported from, else a file that defines it, one in the caller's folder first, else
    external. ``imports`` is (file_path, name, target); the last import of a name counts.

    A name defined in very many files is reduced to the first file of each folder and the first of all before
    any join, so no call meets more than one row of each. Calls are written and counted: names that very many of them
    have are looked up by a broadcast of as few rows as there can be such names, ``share`` at most, so no task gets all calls of one.
    """
    spark = calls.sparkSession
    folder = lambda c: F.regexp_extract(c, r"^(.*/)[^/]*$", 1)
    at, kept = scratch.folder(spark, "calls"), calls.withColumn("folder", folder(F.col("caller_file")))
    kept.write.parquet(at)
    kept = spark.read.schema(kept.schema).parquet(at)
    total = kept.count()
    own = functions.select(F.col("file_path").alias("caller_file"), F.col("name").alias("callee_name")).distinct().withColumn("own", F.lit(True))
    imported = imports.where("target is not null").groupBy(F.col("file_path").alias("caller_file"), F.col("name").alias("callee_name")).agg(F.max_by("target", "ord").alias("imported"))
    first = functions.groupBy("name", "file_path").agg(F.min("ord").alias("ord"))
    anywhere = first.groupBy(F.col("name").alias("callee_name")).agg(F.min(F.struct("ord", "file_path"))["file_path"].alias("anywhere"))
    beside = first.groupBy(F.col("name").alias("callee_name"), folder(F.col("file_path")).alias("folder")).agg(F.min(F.struct("ord", "file_path"))["file_path"].alias("beside"))
    joined = kept.join(shuffled(own), ["caller_file", "callee_name"], "left").join(shuffled(imported), ["caller_file", "callee_name"], "left")
    for table, keys in ((anywhere, ["callee_name"]), (beside, ["callee_name", "folder"])):
        # of fewer calls than ``least`` in all, none can have that many
        joined = joined.join(shuffled(table), keys, "left") if total < least else looked_up(joined, table, keys, frequent(kept, keys, total, share, least))
    return joined.withColumn("callee_file", F.coalesce(F.when(F.col("own"), F.col("caller_file")), "imported", "beside", "anywhere", F.lit(EXTERNAL))).drop("own", "imported", "anywhere", "beside", "folder")


def call_edges(symbols: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """An edge for each call site, of symbols (file_path, kind, name, owner, start_line, end_line, ord), or for those of ``only`` (distinct
    file_path, name)."""
    functions = symbols.where("kind in ('function', 'method')")
    sites = symbols.where("kind = 'call'").select("file_path", "name", "start_line", "ord")
    imports = symbols.where("kind = 'import_name'").select("file_path", "name", F.col("owner").alias("source"), "ord")
    defined, around = functions, functions
    if only is not None:
        sites = sites.join(only, ["file_path", "name"], "left_semi")
        imports = imports.join(only, ["file_path", "name"], "left_semi")
        defined = functions.join(only.select("name").distinct(), "name", "left_semi")
        around = functions.join(only.select("file_path").distinct(), "file_path", "left_semi")
    targets = import_targets(imports, symbols.select("file_path"))
    calls = sites.select("file_path", F.col("name").alias("callee_name"), F.col("start_line").alias("line"), F.col("ord").alias("call_ord"))
    callers = enclosing(calls, around.select("file_path", "name", "start_line", "end_line", "ord")).withColumnRenamed("file_path", "caller_file")
    return resolved(callers, defined, targets).select("caller_file", "caller_name", "callee_file", "callee_name", "line").withColumn("edge_type", F.lit("call"))


def stale_calls(before: DataFrame, now: DataFrame, changed: DataFrame) -> DataFrame:
    """file_path, name: the calls, there before or now, that a change of the files ``changed`` (file_path) may resolve anew.

    Where a call leads depends on its own file, on the files that define its name, and on what its file's import of the name means. So
    these are the calls of changed files; those of names that a changed file defines or did; and those of names that are imported
    from a source one of whose meanings is a file that has come or gone.
    """
    changed = changed.select("file_path").distinct()
    both = before.unionByName(now)
    calls = both.where("kind = 'call'").select("file_path", "name").distinct()
    own = calls.join(changed, "file_path", "left_semi")
    names = both.where("kind in ('function', 'method')").join(changed, "file_path", "left_semi").select("name").distinct()
    named = calls.join(names, "name", "left_semi").select("file_path", "name")
    here = lambda df: df.join(changed, "file_path", "left_semi").select("file_path").distinct()
    moved = here(before).exceptAll(here(now)).unionByName(here(now).exceptAll(here(before))).withColumnRenamed("file_path", "candidate")
    imports = now.where("kind = 'import_name'").select("file_path", "name", F.col("owner").alias("source"))
    meant = imports.select("file_path", "name", F.explode(tries(SUFFIXES)).alias("candidate")).join(moved, "candidate", "left_semi").select("file_path", "name")
    return own.unionByName(named).unionByName(meant.join(calls, ["file_path", "name"], "left_semi")).distinct()


def updated_edges(edges: DataFrame, before: DataFrame, now: DataFrame, changed: DataFrame) -> DataFrame:
    """The call edges of symbols ``now``, from those of symbols ``before`` which differ in the files ``changed`` only: edges that may
    be stale are resolved anew, the others stay. Equal to ``call_edges(now)``."""
    stale = stale_calls(before, now, changed)
    at = stale.select(F.col("file_path").alias("caller_file"), F.col("name").alias("callee_name"))
    kept = edges.where("edge_type = 'call'").join(at, ["caller_file", "callee_name"], "left_anti").select("caller_file", "caller_name", "callee_file", "callee_name", "line", "edge_type")
    return kept.unionByName(call_edges(now, stale))


def degrees(edges: DataFrame, external: bool = False) -> DataFrame:
    """file_path, degree: edges that leave a file or come to it from another."""
    ends = edges.select(F.explode(F.when(F.col("caller_file") == F.col("callee_file"), F.array("caller_file")).otherwise(F.array("caller_file", "callee_file"))).alias("file_path"))
    return ends.where(F.lit(external) | (F.col("file_path") != EXTERNAL)).groupBy("file_path").agg(F.count("*").alias("degree"))


def callers_of(edges: DataFrame, file: str, name: str) -> DataFrame:
    return edges.where((F.col("callee_file") == file) & (F.col("callee_name") == name)).select("caller_file", "caller_name", "line")


def callees_of(edges: DataFrame, file: str, name: str) -> DataFrame:
    return edges.where((F.col("caller_file") == file) & (F.col("caller_name") == name)).select("callee_file", "callee_name", "line")


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Nodes (file, name) that can be reached along edges from the start nodes, these included.

    A breadth-first search: each round joins the frontier with the edges and leaves out what is known. Edges are reduced to what they
    join and written once, in a part for each task, so a round is a scan of these; a hop that several edges make is one again where its round's nodes are. Rounds are
    written to the shared folder, so a lost executor costs one round and plans stay small.
    """
    spark = edges.sparkSession
    at, to, level = scratch.folder(spark, "graph"), scratch.folder(spark, "hops"), 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    hops = edges.where(F.col("callee_file") != EXTERNAL).select(F.col("caller_file").alias("file"), F.col("caller_name").alias("name"), F.col("callee_file").alias("to_file"), F.col("callee_name").alias("to_name"))
    hops.repartition(n, *hops.columns).write.parquet(to)
    hops = spark.read.schema(hops.schema).parquet(to)
    start.select("file", "name").distinct().write.parquet(f"{at}/level={level}")
    schema = "file string, name string, level int"
    while True:
        seen = spark.read.schema(schema).parquet(at)
        frontier = seen.where(F.col("level") == level).drop("level")
        met = hops.join(frontier, ["file", "name"]).select(F.col("to_file").alias("file"), F.col("to_name").alias("name")).distinct()
        met.join(seen.drop("level"), ["file", "name"], "left_anti").write.parquet(f"{at}/level={level + 1}")
        if spark.read.schema("file string, name string").parquet(f"{at}/level={level + 1}").isEmpty():
            return seen.drop("level")
        level += 1


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which an end at least is among the nodes."""
    flag = nodes.select("file", "name").distinct()
    one = flag.select(F.col("file").alias("caller_file"), F.col("name").alias("caller_name"), F.lit(True).alias("from_in"))
    two = flag.select(F.col("file").alias("callee_file"), F.col("name").alias("callee_name"), F.lit(True).alias("to_in"))
    joined = edges.join(one, ["caller_file", "caller_name"], "left").join(two, ["callee_file", "callee_name"], "left")
    return joined.where("from_in or to_in").drop("from_in", "to_in").select(*edges.columns)


def commit_groups(commits: DataFrame) -> DataFrame:
    """hash, files, date: the distinct files of each commit and the date it was first seen with."""
    return commits.where("file_path <> ''").groupBy("hash").agg(F.array_sort(F.collect_set("file_path")).alias("files"), F.min("date").alias("date"))


#: Classes of files of a block, and commits in all of them, about; and how many times as many classes a packed block has.
BLOCK, BLOCK_COMMITS, WIDE = 2048, 2_000_000, 4


def histories(commits: DataFrame, now: Column, half_life: float, min_commits: int) -> DataFrame:
    """file_path, own: its commits as numbers with the decay of each, and key: a hash of the numbers; of files of ``min_commits`` at least. Written."""
    spark = commits.sparkSession
    rows = commits.where("file_path <> ''").groupBy("hash", "file_path").agg(F.min("date").alias("date"))
    dates, at = scratch.folder(spark, "dates"), scratch.folder(spark, "histories")
    # commits by number, written so that the numbers stay
    rows.groupBy("hash").agg(F.min("date").alias("date")).select("hash", F.monotonically_increasing_id().alias("c"), text.decay(F.col("date"), now, half_life).alias("w")).write.parquet(dates)
    numbered = rows.select("hash", "file_path").join(spark.read.schema("hash string, c long, w double").parquet(dates), "hash")
    own = numbered.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("c", "w"))).alias("own")).where(F.size("own") >= min_commits)
    out = own.withColumn("key", F.sha2(F.array_join(F.transform("own.c", lambda c: c.cast("string")), ",").cast("binary"), 256))
    out.write.parquet(at)
    return spark.read.schema(out.schema).parquet(at)


def classes_of(files: DataFrame, keep: int, wide: int = 1) -> DataFrame:
    """Files of the very same commits as a class: id, key, the first ``keep`` members by name, n commits, and these with their weights, dealt
    into blocks by the first of them, so that what lies far apart in time doesn't meet. Written."""
    spark = files.sparkSession
    first = F.row_number().over(Window.partitionBy("key").orderBy("file_path"))
    same = files.withColumn("r", first).where(F.col("r") <= keep).groupBy("key").agg(F.array_sort(F.collect_list("file_path")).alias("members"), F.min_by("own", "r").alias("own"))
    found = same.select(F.monotonically_increasing_id().alias("id"), "key", "members", F.size("own").alias("n"), F.col("own.c").alias("commits"), F.col("own.w").alias("weights"))
    at, dealt = scratch.folder(spark, "classes"), scratch.folder(spark, "blocks")
    found.write.parquet(at)
    known = spark.read.schema(found.schema).parquet(at)
    size = known.agg(F.count("*").alias("n"), F.sum("n").alias("commits")).first()
    n = max(1, -(-size.n // (BLOCK * wide)), -(-(size.commits or 0) // BLOCK_COMMITS))
    blocks = known.repartitionByRange(n, F.array_min("commits"), F.xxhash64("key")).withColumn("block", F.spark_partition_id())
    blocks.write.parquet(dealt)
    out = spark.read.schema(blocks.schema).parquet(dealt)
    # neighbouring parts are a block where Spark made more of them than that, as cells are the square of the blocks
    parts = (out.agg(F.max("block").alias("last")).first().last or 0) + 1
    return out.withColumn("block", F.floor(F.col("block") * n / parts).cast("int")) if parts > n else out


def cells(classes: DataFrame) -> DataFrame:
    """The classes of each pair of blocks (i, j) that have a commit in common, i no greater than j; side says of which block they are."""
    spark = classes.sparkSession
    of = classes.select("block", F.explode("commits").alias("c")).distinct()
    meet = of.withColumnRenamed("block", "i").join(of.withColumnRenamed("block", "j"), "c").where("i <= j").select("i", "j").distinct()
    columns = ["i", "j", "side", "id", "members", "n", "commits", "weights"]
    one = classes.join(meet, F.col("block") == F.col("i")).withColumn("side", F.lit(0)).select(*columns)
    two = classes.join(meet.where("i < j"), F.col("block") == F.col("j")).withColumn("side", F.lit(1)).select(*columns)
    # a fixed number of parts, as work isn't told by bytes here
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return one.unionByName(two).repartition(n, "i", "j")


def packed_blocks(classes: DataFrame) -> DataFrame:
    """Each block of classes packed into a row, so that little is shuffled of the many cells that a block is in. Written."""
    rows = classes.select("block", "id", F.col("members")[0].alias("first"), F.get("members", F.lit(1)).alias("second"), F.col("n").cast("long").alias("n"), "commits", "weights")
    at = scratch.folder(classes.sparkSession, "packed")
    rows.groupBy("block").applyInPandas(shared.packed, shared.BLOCKS).write.parquet(at)
    return classes.sparkSession.read.schema(shared.BLOCKS).parquet(at)


def heaviest_classes(blocks: DataFrame, top: int, min_shared: int, min_rate: float) -> DataFrame:
    """The heaviest ``top`` pairs of classes: of each block first, and then, of no less than these weigh, of each two that have a commit in common."""
    spark = blocks.sparkSession
    meet, found = scratch.folder(spark, "cells"), scratch.folder(spark, "found")
    best = lambda: spark.read.schema(shared.CLASS_PAIRS).parquet(found).orderBy(F.desc("weight"), "file_a", "file_b").limit(top)
    n = blocks.count()
    blocks.repartition(max(1, n), "block").groupBy("block").applyInPandas(lambda pdf: shared.heaviest_pairs(pdf, top, min_shared, min_rate), shared.CLASS_PAIRS).write.parquet(found)
    if n > 1:
        known = best().agg(F.count("*").alias("n"), F.min("weight").alias("least")).first()
        floor = round(known.least * 100) if known.n == top else 0
        of = blocks.select("block", F.explode("commits").alias("c"))
        of.withColumnRenamed("block", "i").join(of.withColumnRenamed("block", "j"), "c").where("i < j").select("i", "j").distinct().write.parquet(meet)
        cell = spark.read.schema("i int, j int").parquet(meet)
        # a part for each cell, about, as each is much work and few bytes
        both = blocks.join(cell.select("i", "j", F.explode(F.array("i", "j")).alias("block")), "block")
        parts = both.repartition(max(1, min(cell.count(), 20_000)), "i", "j")
        parts.groupBy("i", "j").applyInPandas(lambda pdf: shared.heaviest_pairs(pdf, top, min_shared, min_rate, floor), shared.CLASS_PAIRS).write.mode("append").parquet(found)
    return best()


def co_change(commits: DataFrame, now: Column, half_life: float = 365.0, min_commits: int = 3, min_shared: int = 3, min_rate: float = 0.5, top: int = 500) -> DataFrame:
    """Pairs of files that often change in the same commits, the heaviest ``top`` of them.

    Files of too few commits go first. Those of the very same commits are a class, of which ``top`` + 1 members are enough, as a pair with a
    later one comes after as many of the same weight. Classes meet by blocks: a task bounds what those of two blocks share, sums up
    those that may be the heaviest, and lets go of all others. So pairs are never shuffled and memory is bounded; time grows with the
    pairs of unlike files in blocks that have a commit in common. A pair of classes counts by its first pair of files, so ``top`` of them are
    enough, and members are looked up for these only. The commits that a pair shares first and last are looked up for the
    heaviest only. weight is the sum of decayed commits, in two decimals; the rate is of the file with fewer commits.
    """
    spark = commits.sparkSession
    classes = classes_of(histories(commits, now, half_life, min_commits), top + 1, WIDE)
    at, order = scratch.folder(spark, "pairs"), [F.desc("weight"), "file_a", "file_b"]
    firsts = heaviest_classes(packed_blocks(classes), top, min_shared, min_rate)
    sides = firsts.select(F.explode(F.array("one", "two")).alias("id")).distinct()
    members = classes.select("id", "members").join(F.broadcast(sides), "id", "left_semi")
    both = firsts.join(members.withColumnRenamed("id", "one"), "one").join(members.select(F.col("id").alias("two"), F.col("members").alias("others")), "two")
    named = both.select("members", F.when(F.col("one") != F.col("two"), F.col("others")).alias("others"), "weight", "raw_count")
    named.mapInPandas(lambda batches: shared.members_pairs(batches, top), shared.PAIRS).write.parquet(at)
    best = spark.read.schema(shared.PAIRS).parquet(at).orderBy(*order).limit(top)
    rows = commits.where("file_path <> ''").groupBy("hash", "file_path").agg(F.min("date").alias("date"))
    dates = rows.groupBy("hash").agg(F.min("date").alias("date"))
    named = best.select(F.explode(F.array("file_a", "file_b")).alias("file_path")).distinct()
    files = rows.select("hash", "file_path").join(F.broadcast(named), "file_path", "left_semi").join(dates, "hash")
    one, two = files.withColumnRenamed("file_path", "file_a"), files.select("hash", F.col("file_path").alias("file_b"))
    when = F.struct("date", "hash")
    ends = one.join(F.broadcast(best.select("file_a", "file_b")), "file_a").join(two, ["file_b", "hash"]).groupBy("file_a", "file_b").agg(F.max(when).alias("latest"), F.min(when).alias("earliest"))
    found = best.join(ends, ["file_a", "file_b"]).select("file_a", "file_b", "weight", "raw_count", *(F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in ("latest", "earliest") for c in ("hash", "date")))
    return found.orderBy(*order)


def heaviest(commits: DataFrame, now: Column, per_file: int = 5, half_life: float = 365.0, min_commits: int = 3, min_shared: int = 3, min_rate: float = 0.5) -> DataFrame:
    """file_path, other, weight, rank: the heaviest co-changes of each file, of all of its pairs, which are summed up as in ``co_change``.

    A class needs one more than that many others, as a file is no other of its own.
    """
    files = histories(commits, now, half_life, min_commits)
    classes = classes_of(files, per_file + 1)
    of_cells = cells(classes).groupBy("i", "j").applyInPandas(lambda pdf: shared.heaviest_others(pdf, per_file + 1, min_shared, min_rate), shared.OTHERS)
    place = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(F.desc("weight"), "other"))
    best = of_cells.withColumn("rank", place("id")).where(F.col("rank") <= per_file + 1).drop("rank").join(classes.select("id", "key"), "id")
    others = files.select("file_path", "key").join(shuffled(best), "key").where("file_path <> other").select("file_path", "other", "weight")
    return others.withColumn("rank", place("file_path")).where(F.col("rank") <= per_file)


def co_change_edges(pairs: DataFrame) -> DataFrame:
    """Pairs in the shape of call edges."""
    label = F.lit("[co-change]")
    return pairs.select(
        F.col("file_a").alias("caller_file"), label.alias("caller_name"), F.col("file_b").alias("callee_file"), label.alias("callee_name"), F.lit(0).alias("line"),
        F.lit("co-change").alias("edge_type"), "weight", "raw_count", "latest_hash", "latest_date", "earliest_hash", "earliest_date",
    )
