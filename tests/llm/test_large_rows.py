import random
import uuid

import pyarrow.parquet as pq

from hushline import session
from hushline.llm import decontamination


def test_index_files_hold_few_segments_in_a_row_group(spark, tmp_path, monkeypatch):
    """Rows of a megabyte and more: Parquet alone would put a hundred of them into a page and a row group."""
    monkeypatch.setattr(session, "new_folder", lambda spark, purpose: f"{tmp_path}/{purpose}-{uuid.uuid4().hex}")
    rng = random.Random(3)
    known = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    texts = [" ".join(rng.choices(known, k=180_000)) for _ in range(24)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    index = decontamination.build_index(docs)
    files = [pq.ParquetFile(f).metadata for f in tmp_path.glob("index-*/data/*.parquet")]
    groups = [f.row_group(i) for f in files for i in range(f.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 24
    assert max(g.total_byte_size for g in groups) < 12 << 20
    phrase = " ".join(texts[7].split()[1000:1013])
    items = spark.createDataFrame([("seven", phrase)], "item_id string, text string")
    found = {r["doc_id"]: (r["items"], [tuple(s) for s in r["spans"]]) for r in decontamination.search(index, items).collect()}
    assert found.pop(7) == (["seven"], [(1000, 1013)])
    assert len(found) == 23 and set(map(str, found.values())) == {"([], [])"}
