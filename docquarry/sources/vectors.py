"""Vectors kept by the content they were made from, so that no text is sent to a provider twice.

A vector is found by a 256-bit hash of the provider's name, model and dimension and of the whole text. Every run that finds new texts adds
one folder, committed by renaming it; a run that fails leaves none. A key occurs once in all folders.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators.embedding import Provider, embed, embed_by_provider, input_error, require_text_column
from docquarry.schemas import VECTORS
from docquarry.session import list_names, maybe_in, rename_new, stage

KEY = "content_key"
# A key with more than one row in so many is joined by broadcast: fewer keys than this can be that frequent.
FREQUENT = 1_000


def content_key(text: Column, provider: Provider | dict[str, Provider], choice: str | None = None) -> Column:
    """Key of a text under its provider: the only one, or that named in the ``choice`` column, which must be given."""
    if isinstance(provider, Provider):
        return F.unhex(F.sha2(F.concat(F.lit(_identity(provider)), text), 256))
    table = F.create_map(*[F.lit(part) for name, p in provider.items() for part in (name, _identity(p))])
    unknown = F.raise_error(F.concat(F.lit("no such provider: "), F.coalesce(choice, F.lit("NULL")))).cast("string")
    return F.unhex(F.sha2(F.concat(F.coalesce(F.try_element_at(table, F.col(choice)), unknown), text), 256))


def _identity(provider: Provider) -> str:
    return "".join(f"{len(part)}:{part}" for part in (provider.name, provider.model, str(provider.dimension)))


class VectorCache:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _version(self) -> int:
        """Number of the newest folder, 0 if there is none."""
        return max((int(name[1:]) for name in list_names(self.spark, self.root) if name.startswith("v")), default=0)

    def scan(self) -> DataFrame:
        """``(content_key, embedding)`` of all vectors; a key has one row."""
        return self._upto(self._version())

    def _upto(self, version: int) -> DataFrame:
        if not version:
            return self.spark.createDataFrame([], VECTORS)
        return self._read(*[f"{self.root}/v{n}" for n in range(1, version + 1)])

    def _read(self, *paths: str) -> DataFrame:
        return self.spark.read.schema(VECTORS).parquet(*paths)

    def embed(self, df: DataFrame, provider: Provider | dict[str, Provider], choice: str | None = None,
              column: str = "document", out: str = "embedding") -> DataFrame:
        """``embed`` or, with a dict, ``embed_by_provider``; a function gets each text once, and only if no vector is kept for it.

        Vectors of a provider without a function cost less than a look-up and are not kept. The function's calls are made
        here, not when the result is read. ``df`` is computed several times: stage it if it is costly.
        """
        if isinstance(provider, Provider):
            return embed(df, provider, column, out) if provider.function is None else self._looked_up(df, provider, None, column, out)
        plain = {name: p for name, p in provider.items() if p.function is None}
        called = {name: p for name, p in provider.items() if p.function is not None}
        if not called:
            return embed_by_provider(df, plain, choice, column, out)
        if not plain:
            return self._looked_up(df, called, choice, column, out)
        native = F.coalesce(F.col(choice).isin(list(plain)), F.lit(False))
        return embed_by_provider(df.where(native), plain, choice, column, out).unionByName(
            self._looked_up(df.where(~native), called, choice, column, out))

    def _looked_up(self, df: DataFrame, provider: Provider | dict[str, Provider], choice: str | None,
                   column: str, out: str) -> DataFrame:
        """Rows with the vectors of their keys. Text moves only for keys that are new, and once for the rows' own join."""
        require_text_column(df, column)
        if KEY in df.columns:
            raise ValueError(f"the column name {KEY} is taken")
        given = df.drop(out).where(input_error(F.col(column)).isNull())
        keyed = given.withColumn(KEY, content_key(F.col(column), provider, choice))
        counts = stage(keyed.groupBy(KEY).agg(F.count(F.lit(1)).alias("_rows")), "contents")
        version = self._version()
        missing = stage(counts.select(KEY).join(self._upto(version).select(KEY), KEY, "left_anti"), "missing")
        if not missing.isEmpty():
            self._add(keyed, missing, provider, choice, column, version)
        vectors = maybe_in(self.scan(), [KEY], counts).withColumnRenamed("embedding", out)
        total = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
        frequent = counts.where(F.col("_rows") * FREQUENT > total).select(KEY)
        few = vectors.join(F.broadcast(frequent), KEY, "left_semi")
        found = keyed.join(F.broadcast(few), KEY)
        others = keyed.join(F.broadcast(frequent), KEY, "left_anti").join(vectors, KEY, "left")
        return found.unionByName(others).select(*[c for c in df.columns if c != out], out)

    def _add(self, keyed: DataFrame, missing: DataFrame, provider: Provider | dict[str, Provider], choice: str | None,
             column: str, version: int) -> None:
        """Embed one text of every missing key and commit the vectors."""
        wanted = [KEY, column] + ([choice] if choice else [])
        # Copies are reduced before they move; what the filter lets through without need goes after that.
        once = maybe_in(keyed, [KEY], missing).select(*wanted).dropDuplicates([KEY]).join(missing, KEY, "left_semi")
        made = (embed(once, provider, column, "embedding") if isinstance(provider, Provider)
                else embed_by_provider(once, provider, choice, column, "embedding"))
        made = made.select(VECTORS.names)
        while True:
            path = f"{self.root}/new-{uuid.uuid4().hex}"
            made.write.parquet(path)
            try:
                return rename_new(self.spark, path, f"{self.root}/v{version + 1}")
            except Py4JJavaError:
                newest = self._version()
                if newest == version:
                    raise
                # Another run was faster: what it did not add is kept, without calling the function again.
                made, version = self._read(path).join(self._upto(newest).select(KEY), KEY, "left_anti"), newest
