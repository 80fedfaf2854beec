"""Column expressions over whole texts, shared by the operators here."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"


def whole(text: Column) -> Column:
    """The text, with null read as the empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The maximal runs of characters other than ASCII blanks; null has none."""
    return F.array_remove(F.split(whole(text), BLANKS), "")


def windows(items: Column, width: int, join) -> Column:
    """``join(list of width items)`` of every window; an empty array if there are fewer."""
    last = F.size(items) - width
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: join([F.get(items, i + k) for k in range(width)]))


def own_columns(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with none of ``df``'s, whatever its columns are."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        free = f"__{name}"
        while free in taken:
            free = f"_{free}"
        taken.add(free)
        out.append(free)
    return out


def map_texts(rows: DataFrame, column: str, compute, fields: dict[str, str]) -> DataFrame:
    """``rows`` with ``column`` replaced by ``fields`` (name to type).

    ``compute`` is called once a task and gives a function from a list of texts
    to a list of tuples. The other columns pass through as Arrow, so nulls and
    large integers stay what they are.
    """
    kept = [c for c in rows.columns if c != column]
    types = dict(rows.dtypes)

    def run(batches):
        import pyarrow as pa

        kinds = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(),
                 "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
        each = compute()
        for batch in batches:
            made = each(batch.column(column).to_pylist())
            columns = [batch.column(c) for c in kept]
            columns += [pa.array([m[i] for m in made], kinds[t]) for i, t in enumerate(fields.values())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *fields])
    schema = ", ".join([f"`{c}` {types[c]}" for c in kept] + [f"{n} {t}" for n, t in fields.items()])
    return rows.mapInArrow(run, schema)
