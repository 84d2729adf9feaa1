import collections
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from quire.llm import packing, pretokens, token_counts, token_ids
from quire.llm.pretokens import library, tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


def exact(text):
    return library(PATH).encode(text or "", add_special_tokens=False).ids


def encoded(texts):
    out = []
    for _, ids, off in pretokens.encoded(pa.array(texts, pa.string()), PATH):
        out += [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)]
    return out


PARTS = st.sampled_from(["a", "Z", "é", "日", "1", "Ⅷ", "'", "'s", "'ll", "'re", " ", "  ", "\n", "\t", " ", "!", "$", "😀", "̀", "<|endoftext|>", "<|", "the", " of", "\x00", "=" * 9])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=14).map("".join), min_size=1, max_size=4))
def test_ids_and_counts_are_the_librarys(texts):
    want = [exact(t) for t in texts]
    assert encoded(texts) == want
    assert token_counts.count_texts(pa.array(texts), PATH).tolist() == [len(w) for w in want]


def test_long_texts_are_cut_without_a_trace(monkeypatch):
    monkeypatch.setattr(pretokens, "LONG", 50)
    texts = ["some words here, " * 40, "x" * 500, "a b" * 100 + "<|endoftext|>" + "c d " * 60, None]
    assert encoded(texts) == [exact(t) for t in texts]
    assert token_counts.count_texts(pa.array(texts), PATH).tolist() == [len(exact(t)) for t in texts]


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(pretokens.WordCache, "MOST", 20)
    texts = [f"w{i} v{i % 7}" for i in range(200)]
    assert encoded(texts) == [exact(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=900), st.sampled_from([4, 64, 256]))
def test_words_round_trip(values, block):
    v = np.array(values, np.uint64)
    for lengths in ([len(v)], [0, len(v) // 3, 0, len(v) - len(v) // 3]):
        sizes = token_ids.blocks_of(np.array(lengths), block)
        assert sizes.sum() == len(v) and (sizes <= block).all() and (sizes > 0).all()
        words, counts = token_ids.pack(v, sizes)
        assert counts.sum() == len(words) and token_ids.unpack(words, counts, sizes).tolist() == values


def test_damaged_shards_are_refused(monkeypatch):
    lengths = np.array([2, 300, 1])
    ids = np.arange(303)
    words, counts = token_ids.pack(ids, token_ids.blocks_of(lengths))
    raw = token_ids.to_bytes(np.array([1, 2, 3]), np.array([0, 0, 1]), lengths, counts, words.tobytes())
    for slab in (100_000, 1):
        monkeypatch.setattr(token_ids, "SLAB", slab)
        _, nulls, own, slabs = token_ids.from_bytes(raw)
        assert nulls.tolist() == [False, False, True] and own.tolist() == lengths.tolist()
        assert np.concatenate([x for _, x, _ in slabs]).tolist() == ids.tolist()
    for bad in (raw[:-1], raw[:60] + b"\x01" + raw[61:], b""):
        with pytest.raises(ValueError):
            token_ids.from_bytes(bad)


def test_counts(spark, odd, nothing):
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(odd, PATH).collect())
    want = collections.Counter((r.doc_id, len((r.text or "").encode()), n := len(exact(r.text)), n > 512) for r in odd.collect())
    assert got == want
    assert token_counts.token_counts(nothing, PATH).count() == 0


@pytest.mark.parametrize("shard", [250_000, 8])
def test_shards(spark, odd, nothing, monkeypatch, shard):
    monkeypatch.setattr(token_ids, "SHARD_WORDS", shard)
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    want, start = [], 0
    for r in rows:
        ids = [*exact(r.text), 0]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(map(tuple, token_ids.token_ids(odd, PATH).collect()), key=lambda x: x[1])
    assert got == want
    assert token_ids.token_ids(nothing, PATH).count() == 0


def test_packing(spark, odd, nothing):
    size = 64
    rows = packing.pack(odd, PATH, size).collect()
    ids = collections.defaultdict(list)
    for r in odd.collect():
        ids[r.doc_id].append([*exact(r.text), 0])
    sequences = collections.defaultdict(list)
    pieces = collections.Counter()
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)] += 1
    want = collections.Counter()
    for doc, each in ids.items():
        for x in each:
            for a in range(0, len(x), size):
                part = x[a : a + size]
                want[(doc, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(x))] += 1
    assert pieces == want
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert packing.pack(nothing, PATH, size).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(0, 50), max_size=20))
def test_histogram_is_placed_whole(counts):
    patterns = packing.pack_histogram(counts, 32)
    placed = collections.Counter()
    for n, lengths in patterns:
        assert n > 0 and sum(lengths) <= 32
        for length in lengths:
            placed[length] += n
    assert placed == collections.Counter({k: v for k, v in counts.items() if v})
    total, used = sum(n for n, _ in patterns), sum(k * v for k, v in counts.items())
    assert total <= max(2 * -(-used // 32), 1)


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_words_that_polynomial_hashes_confuse():
    words = [w for n in (256, 1024, 2048, 4096, 8192) for w in (thue_morse(n), thue_morse(n, "b", "a"))]
    for texts in (words, words[::-1], [w + " " + v for w, v in zip(words, words[::-1], strict=True)]):
        assert encoded(texts) == [exact(t) for t in texts]
        assert token_counts.count_texts(pa.array(texts), PATH).tolist() == [len(exact(t)) for t in texts]


def test_span_hashes():
    from quire.llm.shared import span_hashes

    texts = [b"", *(bytes([c]) * n for c in (0, 97) for n in (1, 7, 8, 9, 16, 17, 255, 256, 257, 300)), *(thue_morse(1 << k, a, b).encode() for k in range(4, 13) for a, b in ("ab", "ba"))]
    data = np.frombuffer(b"xyz".join([b"", *texts, b""]), np.uint8)
    starts = np.cumsum([3] + [len(t) + 3 for t in texts])[:-1]
    for seed in (0, 1):
        h = span_hashes(data, starts, starts + [len(t) for t in texts], seed)
        assert len(set(h.tolist())) == len(texts)
        for t, x in zip(texts, h.tolist(), strict=True):
            assert span_hashes(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]), seed).tolist() == [x]


def test_pretokens_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(pretokens, "span_hashes", lambda d, s, e, seed=0, f=pretokens.span_hashes: f(d, s, e, seed) if seed else f(d, s, e) % np.uint64(5) + np.uint64(1))
    encoder = pretokens.Encoder(PATH)
    for texts in (["one two three four five six seven", "seven six five"], ["eight two nine three ten", "one one eleven"]):
        data, off = pretokens.flat(pa.array(texts))
        ids, at = encoder.encode(data, off)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [exact(t) for t in texts]


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"model": {"type": "WordPiece"}}, {"model": {"dropout": 0.1}}])
def test_other_tokenizers_are_refused(tmp_path, change):
    import json

    with open(PATH, encoding="utf-8") as f:
        settings = json.load(f)
    for k, v in change.items():
        settings[k] = {**settings[k], **v} if k == "model" else v
    (tmp_path / "t.json").write_text(json.dumps(settings))
    with pytest.raises(ValueError, match="byte-level"):
        pretokens.checked(str(tmp_path / "t.json"))
    assert pretokens.checked(PATH)["model"]["vocab"]
