"""Fill-in-middle transformation by DuckDB inside mapInArrow.

Each Arrow batch is registered with a DuckDB connection of the task and one SQL statement does the whole work: it cuts texts into
tokens (regexp_extract_all), draws from the sha256 of seed and doc_id, joins the token lists' slices (list_slice, array_to_string) and puts
the three parts together. The result goes back as Arrow; Python sees no row. A batch is registered in parts of about PART
bytes of text, so token lists stay small whatever the rows of a batch hold; a single text is never divided. Nothing is shuffled, and
each row depends on nothing but itself, so a lost executor costs its tasks alone.

A text becomes one of three forms. plain: as it is. psm: prefix mark, prefix, suffix mark, suffix, middle mark, middle. spm: suffix
first, then prefix, then middle. Texts that are empty or hold a mark are plain, as the three parts could not be told apart again;
restored() takes an output apart and gives the text back.

Nulls, empties, repeats: a null text is empty, so its output is an empty plain one. A null doc_id draws from the seed alone.
Rows that repeat come as often as they are there, with equal results. A text of white space alone is one token. Columns other
than doc_id and text are left out, so none can clash. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fields, only

#: White space before a word belongs to it; white space that no word follows is a token by itself.
TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
MARKS = ("<P>", "<S>", "<M>")
PART = 4 << 20

SQL = f"""
with cut as (
    select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{TOKEN}') as tokens,
        sha256($seed || ':' || coalesce(cast(doc_id as varchar), '')) as h
    from batch),
drawn as (
    select *, len(tokens) as n, [cast('0x' || substr(h, 1 + 8 * k, 8) as bigint) for k in range(4)] as draws,
        text = '' or contains(text, $p) or contains(text, $s) or contains(text, $m) as whole
    from cut),
formed as (
    select *, case when whole or draws[3] % 100 >= $percent then 'plain' when draws[4] % 100 < $spm then 'spm' else 'psm' end as form,
        least(draws[1] % (n + 1), draws[2] % (n + 1)) as a, greatest(draws[1] % (n + 1), draws[2] % (n + 1)) as b
    from drawn),
sliced as (
    select doc_id, n, form, text,
        case when form <> 'plain' then array_to_string(list_slice(tokens, 1, a), '') end as prefix,
        case when form <> 'plain' then array_to_string(list_slice(tokens, a + 1, b), '') end as middle,
        case when form <> 'plain' then array_to_string(list_slice(tokens, b + 1, n), '') end as suffix
    from formed)
select doc_id, cast(n as bigint) as n, form, cast(length(prefix) as bigint) as prefix_chars, cast(length(middle) as bigint) as middle_chars,
    case form when 'plain' then text when 'psm' then $p || prefix || $s || suffix || $m || middle else $s || suffix || $p || prefix || $m || middle end as output
from sliced"""


def check_marks(marks: tuple[str, str, str]) -> None:
    """Marks have to be told apart wherever they stand: none holds another, and no end of one is the beginning of one."""
    for x in marks:
        for y in marks:
            if not x or (x is not y and x in y) or any(x.endswith(y[:k]) for k in range(1, min(len(x), len(y)) + (x is not y))):
                raise ValueError(f"marks {x!r} and {y!r} could overlap")
    if len(set(marks)) < 3:
        raise ValueError("three different marks are needed")


def parts(batch: pa.RecordBatch, column: str, most: int):
    """The batch in runs of rows whose texts have about `most` bytes; a row is never divided."""
    before = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(before, (before[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, marks: tuple[str, str, str] = MARKS, part: int = PART) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n tokens, form, prefix_chars, middle_chars (null if plain), output.

    percent of the documents are transformed, spm_percent of those to spm, the others to psm; the ends of prefix and middle are drawn
    evenly over the places between tokens.
    """
    check_marks(marks)
    chosen = only(docs, "doc_id", "text")
    schema = StructType([chosen.schema["doc_id"], *fields(n="long", form="string", prefix_chars="long", middle_chars="long", output="string")])
    values = {"seed": str(seed), "percent": percent, "spm": spm_percent, "p": marks[0], "s": marks[1], "m": marks[2]}

    def run(batches):
        import duckdb

        con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        try:
            for batch in batches:
                for some in parts(batch, "text", part):
                    con.register("batch", pa.Table.from_batches([some]))
                    yield from con.sql(SQL, params=values).to_arrow_table().to_batches()
                    con.unregister("batch")
        finally:
            con.close()

    return chosen.mapInArrow(run, schema)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of, from the output and its form alone."""
    p, s, m = (F.lit(x) for x in marks)
    after = lambda x: F.substring(output, F.length(x) + 1, F.length(output))
    part = lambda c, mark, k: F.split_part(c, mark, F.lit(k))
    psm = F.concat(part(after(p), s, 1), part(part(after(p), s, 2), m, 2), part(part(after(p), s, 2), m, 1))
    spm = F.concat(part(part(after(s), p, 2), m, 1), part(part(after(s), p, 2), m, 2), part(after(s), p, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
