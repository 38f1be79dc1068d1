"""Text chunks and nearest vectors."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.session import written

SIZE, OVERLAP = 1500, 200
#: From the strongest break to the weakest.
SEPARATORS = ("\n```", "\n## ", "\n### ", "\n#### ", "\n\n", "\n", "。", "；", " ", "")


def fixed_chunks(df: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk, content): pieces of `size` characters, each begun `size - overlap` after the last."""
    stride = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - overlap) / stride) - 1)
    at = F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long")))
    return df.select(key, text, at.alias("chunk")).select(key, "chunk", F.substring(F.col(text), (F.col("chunk") * stride + 1).cast("int"), F.lit(size)).alias("content"))


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Pieces no longer than size, broken before the strongest separator that allows
    it (which begins the next piece, as a heading does); neighbours share up to
    `overlap` characters of whole parts."""
    if len(text) <= size:
        return [text] if text else []
    mark, weaker = next(((s, separators[i + 1 :]) for i, s in enumerate(separators) if s and s in text), ("", ()))
    parts = [text[i : i + size] for i in range(0, len(text), size - overlap)] if not mark else [p if i == 0 else mark + p for i, p in enumerate(text.split(mark))]
    if not mark:
        return parts
    out: list[str] = []
    held: list[str] = []
    for part in filter(None, parts):
        if len(part) > size:
            if held:
                out.append("".join(held))
                held = []
            out += split_text(part, size, overlap, weaker)
            continue
        if held and sum(map(len, held)) + len(part) > size:
            out.append("".join(held))
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(part) > size):
                held.pop(0)
        held.append(part)
    return [*out, "".join(held)] if held else out


def recursive_chunks(df: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t or "", size, overlap))

    return df.select(key, F.posexplode(pieces(F.col(text))).alias("chunk", "content"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Rows compared at a time: of the table, and of the queries.
ROW_BLOCK, QUERY_BLOCK = 4096, 512
#: Blocks of a partition, about. A task gets the pairs of two partitions, and Spark may send all of them to Python at once.
BLOCKS = 4


def nearest(df: DataFrame, key: str, vector: str, query: Sequence[float] | DataFrame, k: int = 3) -> DataFrame:
    """The k rows most like the query: a top-k plan, one scan without a full sort.
    With a table of queries (same columns) the k rows most like each of them, as (query_<key>, key, similarity)."""
    if isinstance(query, DataFrame):
        return _nearest_each(df, key, vector, query, k)
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.select(key, cosine(F.col(vector), q).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def _blocks(df: DataFrame, key: str, vector: str, rows: int, prefix: str) -> DataFrame:
    """Rows packed into (keys, width, unit vectors as bytes); a vector without direction is NaN."""
    import numpy as np
    import pyarrow as pa

    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows)):
            found = [None if v is None else np.array(v, float) for v in batch.column(1).to_pylist()]
            by_width: dict[int, list[int]] = {}
            for i, v in enumerate(found):
                by_width.setdefault(-1 if v is None else len(v), []).append(i)
            for width, at in by_width.items():
                m = np.array([found[i] for i in at]) if width > 0 else np.full((len(at), 1), np.nan)
                norm = np.sqrt((m * m).sum(1, keepdims=True))
                m = np.divide(m, norm, out=np.full_like(m, np.nan), where=norm > 0)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).take(pa.array(at)).to_pylist()], pa.list_(batch.schema.field(0).type)), pa.array([max(width, 0)], pa.int32()), pa.array([m.tobytes()], pa.binary())], [f"{prefix}keys", f"{prefix}width", f"{prefix}data"])

    return df.select(key, F.col(vector).cast("array<double>")).mapInArrow(run, f"{prefix}keys array<{kind}>, {prefix}width int, {prefix}data binary")


def _dealt(blocks: DataFrame) -> DataFrame:
    kept = written(blocks, "blocks")
    return kept.repartition(max(1, -(-kept.count() // BLOCKS)))


def _nearest_each(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int) -> DataFrame:
    """Blocks of rows against blocks of queries: the top k of each query within a block, then over all blocks. Blocks are made
    once and dealt to small partitions, so that what a task holds does not grow with the tables; the number of tasks does."""
    import numpy as np
    import pyarrow as pa

    of, kind, query_kind = f"query_{key}", df.schema[key].dataType.simpleString(), queries.schema[key].dataType.simpleString()

    def matrix(data: bytes, rows: int) -> np.ndarray:
        return np.frombuffer(data).reshape(rows, -1)

    def best(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ids, widths, datas, query_ids, query_widths, query_datas = (batch.column(c)[r].as_py() for c in range(6))
                rows, each = matrix(datas, len(ids)), matrix(query_datas, len(query_ids))
                if widths and query_widths and widths != query_widths:
                    raise ValueError(f"vectors of {widths} and {query_widths} numbers")
                near = each @ rows.T if widths == query_widths else np.full((len(each), len(rows)), np.nan)
                near = np.where(np.isnan(near), -np.inf, near)
                take = min(k, len(ids))
                out = []
                for i, line in enumerate(near):
                    # equal vectors get equal values only where each is summed in the same way
                    some = np.flatnonzero(line >= np.partition(line, len(line) - take)[len(line) - take] - 1e-9)
                    exact = np.where(np.isfinite(line[some]), (rows[some] * each[i]).sum(1) if widths == query_widths else -np.inf, -np.inf)
                    top = sorted(zip(-exact, (ids[j] for j in some), strict=True))[:take]
                    out += [(query_ids[i], j, None if s == np.inf else -s) for s, j in top]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], batch.schema.field(3).type.value_type), pa.array([x[1] for x in out], batch.schema.field(0).type.value_type), pa.array([x[2] for x in out], pa.float64())], [of, key, "similarity"])

    pairs = _dealt(_blocks(df, key, vector, ROW_BLOCK, "row_")).hint("shuffle_replicate_nl").crossJoin(_dealt(_blocks(queries, key, vector, QUERY_BLOCK, "query_")))
    partial = pairs.mapInArrow(best, f"{of} {query_kind}, {key} {kind}, similarity double")
    nth = F.row_number().over(Window.partitionBy(of).orderBy(F.desc("similarity"), key))
    return partial.withColumn("_nth", nth).where(F.col("_nth") <= k).drop("_nth")
