"""Fill-in-the-middle transformation: documents cut at two hashed places and rearranged, so that a model learns to write what stands between.

The work is SQL of a DuckDB connection inside each task: a slice of an Arrow batch is registered as a table, the text is cut into tokens by
regexp_extract_all, its parts are list_slice and array_to_string of the tokens, the draws are sha256 of seed and doc_id; Arrow comes back, and no
Python runs per row. One thread and a bounded slice at a time; nothing is shuffled, and a lost task is simply run again.

A token is a word with the white space before it, or white space at the end. Of the first four 8-digit groups h1 to h4 of the digest, the prefix ends after
the smaller of h1 % (n + 1) and h2 % (n + 1) tokens and the middle after the larger; h3 decides whether the text stays plain, h4 the order of parts.

Nulls and edges: a null text is an empty one; empty texts and texts that hold a sentinel stay plain; a null doc_id is drawn as an empty string; rows that
share a doc_id are drawn alike; columns of docs pass through, input columns with the names of the added ones are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ethoframe.llm import tokens

ADDED = "n long, form string, prefix_chars long, middle_chars long, output string"
SLICE_BYTES = 4_000_000
#: DuckDB's own memory in a task; a slice of text needs a small part of it.
MEMORY = "512MB"


@dataclass(frozen=True)
class Plan:
    """Percentages of documents that are transformed and, of these, that have the suffix first."""

    seed: int = 42
    rate: int = 50
    suffix_first: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def sql(self, rows: str = "rows") -> str:
        """Rows (place, doc_id, text) to (n, form, prefix_chars, middle_chars, output) in the order of place."""
        p, s, m = (x.replace("'", "''") for x in (self.prefix, self.suffix, self.middle))
        group = lambda i: f"CAST('0x' || substr(digest, {8 * i + 1}, 8) AS UBIGINT)"
        return rf"""WITH tokens AS (
  SELECT place, body, sha256('{self.seed}:' || key) AS digest, regexp_extract_all(body, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM (SELECT place, coalesce(CAST(doc_id AS VARCHAR), '') AS key, coalesce(text, '') AS body FROM {rows})),
cuts AS (
  SELECT *, CAST(least({group(0)} % (len(units) + 1), {group(1)} % (len(units) + 1)) AS BIGINT) AS one, CAST(greatest({group(0)} % (len(units) + 1), {group(1)} % (len(units) + 1)) AS BIGINT) AS two,
         CASE WHEN body = '' OR contains(body, '{p}') OR contains(body, '{s}') OR contains(body, '{m}') OR {group(2)} % 100 >= {self.rate} THEN 'plain'
              WHEN {group(3)} % 100 < {self.suffix_first} THEN 'spm' ELSE 'psm' END AS form
  FROM tokens),
parts AS (
  SELECT place, body, form, CAST(len(units) AS BIGINT) AS n, array_to_string(list_slice(units, 1, one), '') AS head,
         array_to_string(list_slice(units, one + 1, two), '') AS center, array_to_string(list_slice(units, two + 1, len(units)), '') AS tail
  FROM cuts)
SELECT n, form, CASE WHEN form <> 'plain' THEN CAST(length(head) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(center) AS BIGINT) END AS middle_chars,
       CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '{p}' || head || '{s}' || tail || '{m}' || center ELSE '{s}' || tail || '{p}' || head || '{m}' || center END AS output
FROM parts ORDER BY place"""


def fill_in_middle(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """docs with n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output; needs doc_id and text."""
    added = T.StructType.fromDDL(ADDED)
    docs = docs.drop(*added.names)
    schema = T.StructType([*docs.schema.fields, *added.fields])

    def transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        query = plan.sql()
        for batch in batches:
            for part in tokens.slices(batch, most=SLICE_BYTES):
                rows = pa.table({"place": pa.array(range(part.num_rows), pa.int64()), "doc_id": part.column("doc_id"), "text": part.column("text")})
                con.register("rows", rows)
                made = con.sql(query).to_arrow_table().combine_chunks()
                con.unregister("rows")
                columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in made.columns]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], schema.names)

    return docs.mapInArrow(transformed, schema)


def restored(output: Column, form: Column, plan: Plan = Plan()) -> Column:
    """The exact text, from output and form alone: no part holds a sentinel, so the three sentinels cut the output into its parts."""
    sentinels = "|".join(f"\\Q{x}\\E" for x in (plan.prefix, plan.suffix, plan.middle))
    part = F.split(output, sentinels, -1)
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
