"""Every registered query over empty tables, and over tables with rows of nulls and repeated rows, must come to an end."""

import os
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from orbweave.plans import registry

SOURCE = "/root/testdata/sf0.001"
#: One row, or a whole frame, even of nothing.
ALWAYS = {"histogram", "context_statistics", "auto_mndwi_threshold", "change_area_ratio", "valid_bounds", "fourier_2d", "clip_vector_report", "template_ndvi_report"}


@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_every_query(spark, tmp_path, kind):
    for name in os.listdir(SOURCE):
        t = pq.read_table(f"{SOURCE}/{name}")
        nulls = pa.table({c: pa.nulls(3, t.schema.field(c).type) for c in t.column_names})
        pq.write_table(t.slice(0, 0) if kind == "empty" else pa.concat_tables([t.slice(0, 300), t.slice(0, 2), nulls]), tmp_path / name)

    def run(name):
        try:
            return name, registry.queries()[name](spark, str(tmp_path)).count()
        except Exception as e:  # noqa: BLE001
            return name, str(e)[:300]

    with ThreadPoolExecutor(6) as pool:
        found = list(pool.map(run, registry.queries()))
    assert not [x for x in found if isinstance(x[1], str)]
    if kind == "empty":
        assert {name for name, n in found if n} <= ALWAYS


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True)
    assert said.returncode == 0, said.stderr[-500:]
