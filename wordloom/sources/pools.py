"""Pools and templates: YAML scans, canonical tables, and the sinks for curated pools."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, fresh_path

# Categories whose words may carry an opposite, in the order opposites are listed.
NEGATABLE = (
    "color_logic",
    "light_behavior",
    "atmosphere_field",
    "temporal_state",
    "texture_density",
    "medium_render",
)
# The end of every negative prompt.
BASE_NEGATIVES = ("low quality", "blurry", "text", "watermark")

COMPONENTS = T.StructType(
    [
        T.StructField("pool", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("ordinal", T.LongType()),
        T.StructField("word", T.StringType()),
        T.StructField("opposite", T.StringType()),
    ]
)
TEMPLATES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("structure", T.StringType()),
        T.StructField("required_components", T.ArrayType(T.StringType())),
        T.StructField("notes", T.StringType()),
    ]
)


def _documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per file: pool name (file name without suffix) and text."""
    raw = spark.read.text(paths, wholetext=True).select("value", F.input_file_name().alias("path"))
    return raw.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("pool"), "value")


ROWS_AT_ONCE = 4096  # words of a pool file that a task holds as rows


def _items(text: str):
    """(category, word, opposite) of a pool file, item by item: what is held is the text and one item.

    A first pass reads the keys only.  Files whose keys repeat or come from anchors are loaded as a whole, since there a
    later key may change an earlier one.
    """
    import yaml
    from yaml import composer, constructor, parser, reader, resolver, scanner

    try:
        from yaml._yaml import CParser as Parser
    except ImportError:

        class Parser(reader.Reader, scanner.Scanner, parser.Parser):
            def __init__(self, stream):
                reader.Reader.__init__(self, stream)
                scanner.Scanner.__init__(self)
                parser.Parser.__init__(self)

    class Loader(composer.Composer, Parser, constructor.SafeConstructor, resolver.Resolver):
        def __init__(self, stream):
            Parser.__init__(self, stream)
            composer.Composer.__init__(self)
            constructor.SafeConstructor.__init__(self)
            resolver.Resolver.__init__(self)

        def one(self):
            return self.construct_document(self.compose_node(None, None))

        def skip(self):
            depth = 0
            while True:
                event = self.get_event()
                depth += isinstance(event, yaml.CollectionStartEvent) - isinstance(event, yaml.CollectionEndEvent)
                if not depth:
                    return

    def entries(loader):
        """Each key of a map whose value comes next; the caller takes the value."""
        loader.get_event()
        while not loader.check_event(yaml.MappingEndEvent):
            plain = loader.check_event(yaml.ScalarEvent) and loader.peek_event().value != "<<"
            yield loader.one() if plain else None
        loader.get_event()

    def opened():
        loader = Loader(text)
        loader.get_event()  # the stream's and the document's start
        if loader.check_event(yaml.DocumentStartEvent):
            loader.get_event()
        return loader

    def shape():
        """Whether the categories stand under ``components``; None where the file is to be loaded as a whole."""
        loader, keys, inner = opened(), [], []
        if not loader.check_event(yaml.MappingStartEvent):
            return None
        for key in entries(loader):
            if key is None:
                return None
            keys.append(key)
            if loader.check_event(yaml.AliasEvent):
                return None
            if key == "components" and loader.check_event(yaml.MappingStartEvent):
                for category in entries(loader):
                    if category is None or loader.check_event(yaml.AliasEvent):
                        return None
                    inner.append(category)
                    loader.skip()
            elif key == "components":
                return None
            else:
                loader.skip()
        if len(set(keys)) < len(keys) or len(set(inner)) < len(inner):
            return None
        if loader.get_event() and not loader.check_event(yaml.StreamEndEvent):
            return None
        return "components" in keys

    def lists(loader):
        for category in entries(loader):
            if not loader.check_event(yaml.SequenceStartEvent):
                loader.one()  # its anchors may be named later
                continue
            loader.get_event()
            keyed = None
            while not loader.check_event(yaml.SequenceEndEvent):
                item = loader.one()
                keyed = isinstance(item, dict) if keyed is None else keyed
                yield category, keyed, item
            loader.get_event()

    def whole():
        data = yaml.load(text, getattr(yaml, "CSafeLoader", yaml.SafeLoader)) or {}
        for category, items in (data.get("components", data) or {}).items():
            if items and isinstance(items, list):
                for item in items:
                    yield category, isinstance(items[0], dict), item

    def streamed(under):
        loader = opened()
        if not under:
            yield from lists(loader)
            return
        for key in entries(loader):
            if key == "components":
                yield from lists(loader)
            else:
                loader.one()

    under = shape()
    for category, keyed, item in whole() if under is None else streamed(under):
        word, opposite = (item["word"], item.get("opposite")) if keyed else (item, None)
        yield str(category), str(word), opposite


def read_pools(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Components of YAML pools.  Items are words, or maps with ``word`` and ``opposite``.

    Categories without items are left out, and a file without ``components`` is the category map itself.
    ``ordinal`` is the place in the file.
    """

    def parse(batches):
        for pdf in batches:
            for pool, text in zip(pdf["pool"], pdf["value"]):
                rows, n = [], 0
                for category, word, opposite in _items(text):
                    rows.append((pool, category, n, word, opposite))
                    n += 1
                    if len(rows) == ROWS_AT_ONCE:
                        yield pd.DataFrame(rows, columns=COMPONENTS.fieldNames())
                        rows = []
                yield pd.DataFrame(rows, columns=COMPONENTS.fieldNames())

    return _documents(spark, paths).mapInPandas(parse, COMPONENTS)


def read_templates(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    def parse(batches):
        import yaml

        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        for pdf in batches:
            for text in pdf["value"]:  # rows go out file by file
                found = (yaml.load(text, loader) or {}).get("templates", [])
                rows = [(t["id"], t["structure"], list(t["required_components"]), t.get("notes", "")) for t in found]
                yield pd.DataFrame(rows, columns=TEMPLATES.fieldNames())

    return _documents(spark, paths).mapInPandas(parse, TEMPLATES)


def write_pool_files(components: DataFrame, folder: str) -> DataFrame:
    """One YAML file for each pool in ``folder``, as :func:`read_pools` takes them; returns (pool, path, words).

    ``components`` has pool, category, ordinal, word and opposite.  Categories stand in the order of their names, words
    in theirs.  A file is written as its rows come, so a pool of any size takes no memory; a task that runs again writes
    a file of the same name and content.
    """
    rows = components.select("pool", "category", "ordinal", "word", "opposite")
    dealt = rows.repartition("pool").sortWithinPartitions("pool", "category", "ordinal")

    def write(batches):
        import json

        import pyarrow as pa
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(folder)
        system.create_dir(inner, recursive=True)
        out, pool, category, done, n = None, None, None, [], 0
        for b in batches:
            for p, c, w, o in zip(*(b.column(x).to_pylist() for x in (0, 1, 3, 4)), strict=True):
                if out is None or p != pool:
                    if out is not None:
                        out.close()
                        done.append((pool, n))
                    out, pool, category, n = system.open_output_stream(f"{inner}/{p}.yaml"), p, None, 0
                    out.write(b"components:\n")
                if c != category:
                    out.write(f"  {json.dumps(c)}:\n".encode())
                    category = c
                out.write(f"    - word: {json.dumps(w)}\n      opposite: {json.dumps(o)}\n".encode())
                n += 1
        if out is not None:
            out.close()
            done.append((pool, n))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in done], pa.string()), pa.array([f"{folder}/{x}.yaml" for x, _ in done], pa.string()), pa.array([m for _, m in done], pa.int64())],
            ["pool", "path", "words"],
        )

    return cut(dealt.mapInArrow(write, "pool string, path string, words bigint"))


TEMPLATES_A_FILE = 2000


def write_template_files(templates: DataFrame, folder: str, files: int = 1) -> None:
    """YAML files of templates, as :func:`read_templates` takes them: a JSON list is YAML, and so is one line of it.

    ``files``, or as many as it takes for about ``TEMPLATES_A_FILE`` templates each, since a file is parsed as a whole.
    """
    files = max(files, math.ceil(templates.count() / TEMPLATES_A_FILE))
    one = F.to_json(F.struct("id", "structure", "required_components", F.coalesce("notes", F.lit("")).alias("notes")))
    def headed(batches):
        import pyarrow as pa

        first = True
        for b in batches:
            if b.num_rows and first:
                yield pa.RecordBatch.from_arrays([pa.array(["templates:"])], ["value"])
                first = False
            yield b

    lines = templates.repartition(files, "id").select(F.concat(F.lit("- "), one).alias("value"))
    lines.mapInArrow(headed, "value string").write.text(folder)


def only(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Rows of the named values; an error when none of them exists."""
    kept = df.filter(F.col(column).isin(*names))
    if kept.isEmpty():
        raise ValueError(f"no {column} named {', '.join(names)}")
    return kept


def distinct_words(components: DataFrame) -> DataFrame:
    """Every word once, at its first place."""
    return components.groupBy("word").agg(F.min("ordinal").alias("ordinal"))


def word_category(components: DataFrame, by: list[str] = ["pool"]) -> DataFrame:
    """Word to category; the last category wins for a repeated word."""
    return components.groupBy(*by, "word").agg(F.max_by("category", "ordinal").alias("category"))


def categories(components: DataFrame) -> DataFrame:
    return components.select("category").distinct()


def seed_words(definitions: DataFrame, components: DataFrame) -> DataFrame:
    """Category definitions with their seed words, one row per seed; a category without seeds keeps one row."""
    seeds = components.select("category", F.col("ordinal").alias("seed_ordinal"), F.col("word").alias("seed"))
    return definitions.join(seeds, "category", "left")


def count_by_category(components: DataFrame) -> DataFrame:
    return components.groupBy("category").agg(F.count(F.lit(1)).alias("count"))


def write_pool(components: DataFrame, path: str, order: list[str | Column] = ["category", "ordinal"]) -> None:
    """Rows in category order, as Parquet: a distributed sort, no single-file step."""
    components.orderBy(*order).write.mode("overwrite").parquet(path)


def selected_pool(selected: DataFrame, opposites: DataFrame) -> DataFrame:
    """Selected words in rank order, with the opposite where one is known."""
    return selected.join(opposites.select("category", "word", "opposite"), ["category", "word"], "left").select(
        "category", "rank", "word", "opposite"
    )


def update_opposites(components: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pool with recomputed opposites where there are any."""
    new = pairs.select("category", "word", F.col("opposite").alias("_new"))
    rest = [c for c in components.columns if c != "opposite"]
    return components.join(new, ["category", "word"], "left").select(*rest, F.coalesce("_new", "opposite").alias("opposite"))


def replace_table(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Overwrite a table that ``df`` may itself read: write aside first, then copy over."""
    aside = fresh_path(spark, "aside")
    df.write.parquet(aside)
    spark.read.parquet(aside).write.mode("overwrite").parquet(path)


def word_snapshot(components: DataFrame) -> DataFrame:
    """Distinct words per category, in a form that sorts: one row per word."""
    return components.select("category", "word").distinct()
