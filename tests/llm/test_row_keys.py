import random
from collections import Counter

import pytest

from sentrylake.llm import decontaminate, near_copies, simhash_dedup

from .helpers import text


@pytest.mark.parametrize("keep_one", [near_copies.keep_one, simhash_dedup.keep_one])
def test_one_row_of_each_group(spark, keep_one):
    r = random.Random(1)
    a, b, c, d, e = (text(r, 80) for _ in range(5))
    rows = [(1, a), (1, a), (None, a), (None, b), (None, b), (2, c), (3, c), (3, d), (None, e), (4, e)]
    out = keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    # the other text under id 3 is alone in its group; a row with an id goes before one without
    assert Counter(map(tuple, out.collect())) == Counter([(1, a), (None, b), (2, c), (3, d), (4, e)])


@pytest.mark.parametrize("size", [32 << 20, 0])
def test_contaminated_rows_only(spark, size):
    r = random.Random(2)
    item = text(r, 14)
    bad, clean = "x " + item + " y", text(r, 40)
    rows = [(None, bad), (None, clean), (1, bad), (1, clean), (2, clean), (2, clean)]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = decontaminate.keep_uncontaminated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), items, size)
    assert Counter(map(tuple, out.collect())) == Counter(x for x in rows if x[1] == clean)
