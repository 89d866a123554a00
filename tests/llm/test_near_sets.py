"""What near-dedup hands on with the sets of members."""

import pyarrow as pa

from siltstone.llm import near_dedup


def test_members_keep_root_and_blocks_beside_their_sets():
    """A set's root comes with its text: no join of sets with their places, which would shuffle all sets, is needed."""
    texts = ["a b c d e f", "g h i j k", "a b c d e f", "other"]
    digests = [near_dedup.set_digest(near_dedup.shingles(t)) for t in texts[:3]] + [b"of another text"]
    batch = pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(texts), pa.array([b"r1", b"r2", b"r1", b"r3"], pa.binary()), pa.array([None, 3, None, None], pa.int32())], names=["_digest", "text", "root", "blocks"])
    (out,) = near_dedup.member_sets(iter([batch]))
    assert [(r["digest"], r["root"], r["blocks"]) for r in out.to_pylist()] == [(digests[0], b"r1", None), (digests[1], b"r2", 3)]
    assert out.column(1).to_pylist() == [near_dedup.shingles(t).tobytes() for t in texts[:2]]
