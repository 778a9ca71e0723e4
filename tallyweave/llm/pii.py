"""Finding and replacing personal information in the texts of a table."""

from __future__ import annotations

import hashlib
import inspect
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyweave.llm import pii_examples, pii_tagger
from tallyweave.llm.pii_tagger import TOKENIZER_DIR, default_weights, find_spans
from tallyweave.sources.tables import shared_dir

#: Characters that a task tags at once.
BATCH_CHARS = 600_000


def stored_weights(spark: SparkSession, rows: int) -> dict[str, np.ndarray]:
    """The trained weights (some MB): a table of one row in the shared folder, made by the first who needs it.

    Its name is a digest of the labelled table and the tagger, so a change of either trains anew.
    """
    code = "".join(inspect.getsource(m) for m in (pii_examples, pii_tagger))
    path = f"{shared_dir(spark)}/tallyweave/pii-weights-{hashlib.sha256(f'{rows} {code}'.encode()).hexdigest()[:20]}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        out = io.BytesIO()
        np.savez_compressed(out, **default_weights(rows))
        spark.createDataFrame([(bytearray(out.getvalue()),)], "weights binary").coalesce(1).write.mode("overwrite").parquet(path)
    with np.load(io.BytesIO(spark.read.schema("weights binary").parquet(path).first()[0])) as z:
        return {k: z[k] for k in z.files}


def _spread(spark: SparkSession, documents: DataFrame, key: str, text: str) -> DataFrame:
    """key, text as the files are split; only a table of fewer filled splits than there are cores is dealt out,
    as tagging is work for the CPU. Telling reads no column. Rows without text are kept."""
    docs = documents.select(F.col(key), F.col(text).alias("text"))
    cores = spark.sparkContext.defaultParallelism
    filled = documents.select(F.spark_partition_id().alias("p")).distinct().count()
    return docs if filled >= cores else docs.repartition(cores * 2)


def _chunks(batch: pa.RecordBatch):
    keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    k, t, size = [], [], 0
    for key, text in zip(keys, texts):
        k.append(key)
        t.append(text or "")
        size += len(t[-1])
        if size >= BATCH_CHARS:
            yield k, t
            k, t, size = [], [], 0
    if k:
        yield k, t


def find_pii(spark: SparkSession, documents: DataFrame, key: str = "doc_id", text: str = "text", rows: int = 6000, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """key, pii_type, pii_text: each distinct exact substring found in a text, once per type.

    rows bounds the labelled table the tagger is trained on (in the driver, once for a shared folder).
    tokenizer_dir holds the public vocabularies on every executor. Null, empty and
    blank texts give no rows; texts of any length are tagged whole; a repeated key gives the
    distinct findings of each of its rows. Other columns are ignored.
    """
    weights = spark.sparkContext.broadcast(stored_weights(spark, rows))
    schema = pa.schema([(key, to_arrow_type(documents.schema[key].dataType)), ("pii_type", pa.string()), ("pii_text", pa.string())])

    def run(batches):
        for b in batches:
            for keys, texts in _chunks(b):
                found = [(k, kind, t[i:j]) for k, t, spans in zip(keys, texts, find_spans(weights.value, texts, tokenizer_dir)) for kind, i, j in spans]
                found = list(dict.fromkeys(found))
                yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], schema.field(n).type) for n in range(3)], schema=schema)

    kind = documents.schema[key].dataType.simpleString()
    docs = _spread(spark, documents, key, text).filter(F.length(F.trim("text")) > 0)
    return docs.mapInArrow(run, f"`{key}` {kind}, pii_type string, pii_text string")


def redact_pii(spark: SparkSession, documents: DataFrame, key: str = "doc_id", text: str = "text", rows: int = 6000, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """key, text, n_replaced: every text with ``[TYPE]`` in place of what was found, all else unchanged.

    A null text stays null; each row of documents gives one row.
    """
    weights = spark.sparkContext.broadcast(stored_weights(spark, rows))
    schema = pa.schema([(key, to_arrow_type(documents.schema[key].dataType)), ("text", pa.string()), ("n_replaced", pa.int32())])

    def run(batches):
        for b in batches:
            nulls = iter(b.column(1).is_null().to_pylist())
            for keys, texts in _chunks(b):
                out, n = [], []
                for t, spans in zip(texts, find_spans(weights.value, texts, tokenizer_dir)):
                    parts, at = [], 0
                    for kind, i, j in spans:
                        parts += [t[at:i], f"[{kind}]"]
                        at = j
                    out.append(None if next(nulls) else "".join(parts) + t[at:])
                    n.append(len(spans))
                yield pa.RecordBatch.from_arrays([pa.array(keys, schema.field(0).type), pa.array(out, pa.string()), pa.array(n, pa.int32())], schema=schema)

    kind = documents.schema[key].dataType.simpleString()
    return _spread(spark, documents, key, text).mapInArrow(run, f"`{key}` {kind}, text string, n_replaced int")
