import pyarrow as pa

from sandpiper.llm import chunks, tokens


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])


def test_parcels_are_small_and_leave_nothing_out():
    texts = [f"{k} " + "word " * 400 for k in range(6000)] + ["x" * 3_000_000, None, ""]
    given = [batch(texts[:6000]), batch(texts[6000:])]
    got = list(tokens.parcels(given))
    assert [t for b in got for t in b.column("text").to_pylist()] == texts
    assert max(b.nbytes for b in got[:-3]) <= 1.1 * (1 << 20) and max(b.num_rows for b in got) <= 4096


def test_memory_is_given_back_after_the_last_parcel(monkeypatch):
    asked = []
    monkeypatch.setattr(tokens, "_trim", asked.append)
    rows = tokens.parcels([batch(["a", "b"])])
    assert next(rows).num_rows == 2 and not asked
    assert list(rows) == [] and asked == [0]
    monkeypatch.setattr(tokens, "_trim", None)
    tokens.relieve()
    assert chunks.relieve is tokens.relieve
