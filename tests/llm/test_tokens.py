import io
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from strophe.llm import packing, sentencepieces, token_files, tokens

ODD = ["", " ", "\n", "a", "Hello  world", "  a\nb ", "é ﬁ ½ x\ty", "日本語 <s> <|endoftext|> x", "don't WE'LL it's 12 345", "a\r\nb\x0bc\xa0d", "aaaa aaaaaaaaa abababab", "🎉🎉 x", "Straße ΣΑΣ İx", "é äb", "... --- !!??", "\n\n a\n b  c", "▁x a"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_word_encoder_equals_the_library(name, prose):
    spec = tokens.read_spec(P.path(name))
    whole = Tokenizer.from_str(spec)
    whole.encode_special_tokens = True
    encoder = tokens.WordEncoder(spec)
    assert encoder.kind == name.split("_")[0]
    for text in [*ODD, prose(1, 500), prose(2, 300).replace(" ", ", ").upper(), *("".join(random.Random(k).choices("aé .,\n'0ß\tA", k=60)) for k in range(200))]:
        assert encoder.encode(text) == tokens.packed(whole.encode(text, add_special_tokens=False).ids), text


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_queries_encoder_equals_the_plain_call(name, prose):
    whole = Tokenizer.from_file(P.path(name))
    encoder = tokens.encoder(tokens.read_spec(P.path(name)))
    odd = [f"a{chr(c)}b x{chr(c)} {chr(c)}y" for c in [*range(0x21), 0x7F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]]
    special = ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|>y\n<|endoftext|>", "<|startoftext|> A", "<|END oftext|>", "<|endoftext|", prose(3) + "<|endoftext|>" + prose(4)]
    for text in [*ODD, *odd, *special, prose(1, 500)]:
        assert encoder.encode(text) == tokens.packed(whole.encode(text, add_special_tokens=False).ids), text


def test_fill_windows_uses_every_length_once_and_fills():
    rng = random.Random(3)
    for _ in range(30):
        counts = {n: rng.randint(1, 9) for n in rng.sample(range(1, 64), 12)}
        left = dict(counts)
        for pattern, times in packing.fill_windows(counts, 64):
            assert sum(n * c for n, c in pattern.items()) <= 64
            for n, c in pattern.items():
                left[n] -= c * times
        assert not any(left.values())


def test_fill_windows_finds_the_least_slack():
    for pattern, _ in list(packing.fill_windows({40: 1, 30: 1, 17: 1, 9: 1, 7: 2}, 64))[:1]:
        assert sum(n * c for n, c in pattern.items()) == 64  # 40 + 17 + 7; taking 30 or 9 first would leave slack


def test_pack_documents(spark, docs_of, odd_rows, prose):
    rows = odd_rows + [(k, prose(k, k % 300)) for k in range(100, 300)]
    out = packing.pack_documents(docs_of(rows), P.path("byte_bpe_50k.json"), 256, 1, keep_ids=True)
    got = out.toPandas()
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = sorted(sum(([i for i in whole.encode(t or "", add_special_tokens=False).ids] + [1] for _, t in rows), []))
    assert sorted(sum((list(x) for x in got.ids), [])) == want
    for p in got.itertuples():
        assert len(p.ids) == p.length and zlib.crc32(struct.pack(f"<{p.length}I", *p.ids)) == p.ids_crc32
    total = 0
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 256
        total += 1
    assert got.length.sum() > 0.97 * 256 * (total - 2)
    made = packing.sequences(out, 256).toPandas()
    assert len(made) == total and all(len(x) == 256 or n & (n - 1) == 0 for x, n in zip(made.input_ids, made.n_tokens, strict=True))


def test_pack_nothing(docs_of):
    assert packing.pack_documents(docs_of([]), P.path("byte_bpe_50k.json")).count() == 0


def test_token_file_reads_single_documents():
    sink = io.BytesIO()
    writer = token_files.Writer(sink, frame_bytes=64)
    docs = {k: tokens.packed(range(k, k + k % 40)) for k in range(50)}
    for k, ids in docs.items():
        writer.add(k, ids)
    writer.close()
    reader = token_files.Reader(sink, len(sink.getvalue()))
    assert {d: ids for d, _, ids in reader.documents()} == docs
    touched = []
    frame = reader.frame
    reader.frame = lambda k: touched.append(k) or frame(k)
    assert [(d, ids) for d, _, ids in reader.documents([7, 31])] == [(7, docs[7]), (31, docs[31])] and len(touched) == 2 < len(reader.frames)
    data = bytearray(sink.getvalue())
    data[int(reader.at[1]) + 12] ^= 1
    with pytest.raises(Exception):  # noqa: B017
        list(token_files.Reader(io.BytesIO(bytes(data)), len(data)).documents())


def test_a_plain_decoder_reads_the_file():
    import zstandard

    sink = io.BytesIO()
    writer = token_files.Writer(sink, frame_bytes=16)
    for k in range(5):
        writer.add(k, tokens.packed([k, k + 1, k + 2]))
    writer.close()
    back = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(sink.getvalue()), read_across_frames=True).read()
    assert back == b"".join(tokens.packed([k, k + 1, k + 2]) for k in range(5))


def test_write_and_read(docs_of, odd_rows, prose):
    rows = odd_rows + [(k, prose(k, 30)) for k in range(60, 10, -1)]
    got = token_files.write_and_read(docs_of(rows), P.path("word_bpe_49k.json")).toPandas().sort_values("start")
    whole = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    at = 0
    for p, (doc, text) in zip(got.itertuples(), sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        assert (p.doc_id == doc or (doc is None and p.doc_id != p.doc_id)) and p.start == at and list(p.ids) == ids
        at += len(ids)


def test_write_and_read_nothing(docs_of):
    assert token_files.write_and_read(docs_of([]), P.path("word_bpe_49k.json")).count() == 0


def test_read_requested(docs_of, prose, spark):
    from strophe.llm import common

    folder = common.fresh_dir(spark, "files")
    manifest = token_files.write_files(docs_of([(k, prose(k, 50)) for k in range(20)]), folder, P.path("word_bpe_49k.json"))
    assert sorted(r.doc_id for r in token_files.read_files(manifest, folder, [3, 11, 99]).collect()) == [3, 11]


def test_sentencepiece_equals_the_library(docs_of, odd_rows, prose):
    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*ODD, *(" " * k + "x" for k in range(20)), *("".join(random.Random(k).choices("aebt hin.\n▁ ", k=80)) for k in range(300)), prose(1, 800)]
    worker = sentencepieces.Encoder(sentencepieces.Pieces.read(path))
    for text, ids in zip(texts, worker.encode(texts), strict=True):
        want = sp.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert worker.decode(ids) == sp.decode(want), text
    out = sentencepieces.encode(docs_of(odd_rows), path, decoded=True)
    got = {(r.doc_id, r.n_tokens): r for r in out.collect()}
    assert len(got) == len({(i, len(sp.encode(t or ""))) for i, t in odd_rows}) and all(r.round_trip for r in got.values())
    assert sentencepieces.decode(out, path).where("text is null").count() == 0
    assert sentencepieces.encode(docs_of([]), path).count() == 0


def test_unigram_walk_is_the_best_of_all_segmentations():
    import itertools
    import math

    rng = random.Random(5)
    pieces = ["<unk>", "▁", "a", "b", "c", *("".join(rng.choices("abc", k=rng.randint(2, 4))) for _ in range(25))]
    pieces = list(dict.fromkeys(pieces))
    scores = [0.0] + [-rng.random() * 9 for _ in pieces[1:]]
    worker = sentencepieces.Encoder(sentencepieces.Pieces(pieces, scores, [0], [], 0, bpe=False))
    score = dict(zip(pieces[1:], scores[1:], strict=True))
    words = sorted({"▁" + "".join(w) for n in (3, 6) for w in itertools.islice(itertools.product("abc", repeat=n), 0, None, 7)})

    def best(w):
        top = [0.0] + [-math.inf] * len(w)
        for e in range(1, len(w) + 1):
            for s in range(e):
                if w[s:e] in score:
                    top[e] = max(top[e], top[s] + score[w[s:e]])
        return top[-1]

    for word, ids in worker.walk(words).items():
        assert "".join(pieces[i] for i in ids) == word and abs(sum(scores[i] for i in ids) - best(word)) < 1e-9
