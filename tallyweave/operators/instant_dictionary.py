"""Normalising timestamp texts through a dictionary of distinct values.

The commonest writing, a whole ISO date and time with its offset, is unambiguous by itself and read by
the JVM. Of all others each distinct (text, zone, locale) is parsed once, whatever the number of rows
that have it. The dictionary is a table of the shared folder that grows by the values it doesn't have
yet, in every run and for every table: an entry depends on nothing but its three texts and the parser.
Instants come back to the rows by a join that spreads frequent values over many tasks.
"""

from __future__ import annotations

import hashlib
import inspect

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import instants
from tallyweave.functions.instants import parse_instant
from tallyweave.sources.tables import salted_lookup, shared_dir

KEYS = ["value", "zone", "locale"]
#: Date, time to at most microseconds, and offset; what isn't an instant in this writing is left to the parser.
_PLAIN = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d{1,6})?(?:Z|[+-]\d\d:\d\d)$"
#: Values that one task parses.
PER_TASK = 20_000
_SCHEMA = "value string, zone string, locale string, micros bigint"


def _parse(batches):
    for b in batches:
        v, z, c = (b.column(b.schema.get_field_index(k)).to_pylist() for k in KEYS)
        yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in KEYS), pa.array(map(parse_instant, v, z, c), pa.int64())], ["value", "zone", "locale", "micros"])


class InstantDictionary:
    """The dictionary stored at ``path``, which must be on storage shared by all executors.

    Without a path it is the one of the shared folder, named by the parser's digest: a changed parser
    begins a new dictionary.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        code = hashlib.sha256(inspect.getsource(instants).encode()).hexdigest()[:16]
        path = path or f"{shared_dir(spark)}/tallyweave/instants-{code}"
        self.spark, self.path = spark, path
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._exists = lambda: p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    def read(self) -> DataFrame:
        return self.spark.read.schema(_SCHEMA).parquet(self.path) if self._exists() else self.spark.createDataFrame([], _SCHEMA)

    def extend(self, values: DataFrame, about: int = 0) -> None:
        """Parse the values (distinct on KEYS, ``about`` so many) that aren't there yet and append them."""
        new = values.select(*KEYS)
        if self._exists():
            new = new.join(self.read().select(*KEYS), KEYS, "left_anti")
        new = new.repartition(max(1, -(-about // PER_TASK)), *KEYS)  # parsing is work for the CPU, not for few tasks
        new.mapInArrow(_parse, _SCHEMA).write.mode("append").option("compression", "zstd").parquet(self.path)

    def normalise(self, rows: DataFrame, row_key: str, value: str, zone: str, locale: str) -> DataFrame:
        """rows with ``micros``; rows whose text denotes no instant (or is null) are left out.

        A missing zone or locale is the empty text in the dictionary: such texts are read if they
        carry a zone of their own, and numeric dates then begin with the day. ``rows`` is read twice
        and should be a stored table. Columns named value, zone, locale or micros are replaced.
        """
        keyed = rows.filter(F.col(value).isNotNull()).select(*[c for c in rows.columns if c not in {value, zone, locale, *KEYS, "micros"}], F.col(value).alias("value"), F.coalesce(F.col(zone), F.lit("")).alias("zone"), F.coalesce(F.col(locale), F.lit("")).alias("locale"))
        plain = F.when(F.col("value").rlike(_PLAIN), F.unix_micros(F.col("value").try_cast("timestamp")))
        keyed = keyed.withColumn("micros", plain)
        rest = keyed.filter("micros is null").drop("micros")
        distinct = rest.select(*KEYS).distinct()
        total = rest.count()
        self.extend(distinct, total)
        # two runs at once may have parsed the same text, with the same result
        entries = self.read().filter(F.col("micros").isNotNull()).groupBy(*KEYS).agg(F.min("micros").alias("micros"))
        return keyed.filter("micros is not null").unionByName(salted_lookup(rest, entries, KEYS, F.col(row_key), total))
