"""What the store of files keeps, and where."""

import numpy as np

from weftline.llm import media


def test_only_shared_chunks_leave_their_file(spark):
    rng = np.random.default_rng(8)
    own = [" ".join(f"w{x}" for x in rng.integers(0, 10**9, 3000)) for _ in range(3)]
    rows = [(0, own[0] + own[2]), (1, own[1] + own[2]), (2, own[1][:4000]), (3, None), (4, own[0] + own[2])]
    store = media.ChunkStore(spark.createDataFrame(rows, "doc_id long, text string"))
    bodies = [media.chunked(media.encoded(media.payload_of(t)[1])) for t in dict(r[::-1] for r in rows)]
    uses = {}
    for b in (c for f in bodies for c in set(f)):
        uses[b] = uses.get(b, 0) + 1
    kept = [r["body"] for r in store.chunks.collect()]
    assert len(kept) == len(set(kept)) and {b for b, n in uses.items() if n > 1} <= set(kept)
    assert len(kept) < 0.8 * len(uses)
    for r in store.whole.collect():
        assert [i for i, b in enumerate(r["bodies"]) if b is None] == r["shared"]
    got = {r["media"]: r for r in store.read().collect()}
    assert len(got) == 4
    for f in bodies:
        assert got[media.digest(b"".join(f))]["media_bytes"] == sum(map(len, f))
