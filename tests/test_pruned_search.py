"""Pruned exact search equals the full one and reads few cells where vectors are clustered."""

import numpy as np
import pytest

from kbweave.operators.pruned_search import search_cells, write_cells
from kbweave.operators.search import search_topk

DIM = 24


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v] if v is not None else None) for i, v in enumerate(vectors)], "id long, embedding array<float>")


def same(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "id", "similarity").collect())


@pytest.mark.parametrize("spread, most", [(0.02, 0.5), (3.0, 1.0)])
def test_equal_to_the_full_search(spark, tmp_path, spread, most):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((12, DIM))
    vectors = [c + spread * rng.standard_normal(DIM) for c in centres for _ in range(60)]
    vectors += [centres[0]] * 50 + [np.zeros(DIM), np.full(DIM, np.nan), None]
    rows = frame(spark, vectors)
    write_cells(rows, f"{tmp_path}/cells", rows_per_cell=20)
    asked = frame(spark, [centres[0], centres[5] + 0.01, -centres[3], np.zeros(DIM), np.ones(3), None]).withColumnRenamed("id", "query_id")
    found = search_cells(asked.limit(2), f"{tmp_path}/cells", rows, 30)
    assert same(found.hits) == same(search_topk(asked.limit(2), rows, 30)) and found.cells_read <= most * found.cells
    odd = search_cells(asked, f"{tmp_path}/cells", rows, 7)
    assert same(odd.hits) == same(search_topk(asked, rows, 7))
    assert search_cells(asked.limit(0), f"{tmp_path}/cells", rows, 7).hits.count() == 0
    everything = search_cells(asked.limit(1), f"{tmp_path}/cells", rows, 5000)
    assert same(everything.hits) == same(search_topk(asked.limit(1), rows, 5000))


def test_mixed_dimensions_and_nothing(spark, tmp_path):
    with pytest.raises(ValueError, match="vectors of 2 and of 3 entries"):
        write_cells(frame(spark, [np.ones(2), np.ones(3)]), f"{tmp_path}/mixed")
    nothing = frame(spark, [np.ones(2)]).limit(0)
    write_cells(nothing, f"{tmp_path}/empty")
    assert search_cells(frame(spark, [np.ones(2)]).withColumnRenamed("id", "query_id"), f"{tmp_path}/empty", nothing, 3).hits.count() == 0
