"""Operators on texts against plain re-computation, on rows of every awkward kind."""

import hashlib
import zlib

import numpy as np
import pytest

from quantgrove.llm import fingerprints, media, packing, sentencepieces, token_store, tokens

from .conftest import TEXTS


def key(row):
    return (-(2**63) if row[0] is None else row[0], row[1] or "")


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_fingerprints(request, table):
    got = fingerprints.fingerprint(request.getfixturevalue(table)).collect()
    rows = sorted(((i, t or "") for i, t in TEXTS), key=key)
    want = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        want.append((i, len(t), hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_chars"], r["edited_sha256"])) for r in got)
    prints = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints.setdefault(r["doc_id"], r["fingerprint"])
    assert prints[3] == prints[1] and prints[4] == "" and prints[8] != prints[9]


def test_syncmers_do_not_depend_on_context():
    inner = "the quick brown fox jumps over the lazy dog and runs away from the very angry bear "
    a, b = (set(fingerprints.syncmers(x + inner * 2)[0].tolist()) for x in ("prefix one ", "some other start, longer than that: "))
    whole = set(fingerprints.syncmers(inner * 2)[0].tolist())
    assert len(a & b & whole) > 0.7 * len(whole)  # all but those that reach over the passage's ends


def test_syncmers_brute_force():
    text, k, s = "abracadabra, said the wizard of the lost valley", 12, 5
    codes = [0] * (k - 1) + [ord(c) + 1 for c in text] + [0] * (k - 1)
    windows = lambda w: fingerprints._mix(fingerprints._windows(np.array(codes, np.uint64), w)).tolist()
    inner = windows(s)
    want = [i for i in range(len(codes) - k + 1) if min(inner[i : i + k - s + 1]) in (inner[i], inner[i + k - s])]
    assert fingerprints.syncmers(text, k, s)[1].tolist() == want


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_media_round_trip(spark, request, table):
    listed = media.store(request.getfixturevalue(table), media.folder_for(spark), archive_bytes=20_000)
    assert listed.count() > 1
    got = media.features(media.load(spark, listed, range_bytes=5000)).collect()

    def want(i, t):
        raw = (t or "").encode()
        pay = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        return str((i, len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:])))

    assert sorted(want(i, t) for i, t in TEXTS) == sorted(str((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"])) for r in got)
    assert len({(r["payload_sha256"], r["n_bytes"]) for r in got}) == len({r["media_sha256"] for r in got})


def test_a_member_is_read_again_after_a_fault(tmp_path):
    import io
    import zipfile

    path = str(tmp_path / "a.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for i in range(3):
            z.writestr(f"{i}.png", media.to_image(media.padded(b"x" * i), i))
    info = zipfile.ZipFile(path).infolist()[1]
    faults = [OSError("gone"), io.BytesIO(b"damaged" * 1000)]

    def opener(at):
        if faults:
            f = faults.pop(0)
            if isinstance(f, Exception):
                raise f
            return f
        return open(at, "rb")

    data, reads = media.read_member(path, info, 4, 0.0, opener)
    assert reads == 3 and media.from_image(data)[1] == 1
    with pytest.raises(OSError, match="1.png"):
        media.read_member(path, info, 2, 0.0, lambda at: io.BytesIO(b""))


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_tokenizer())
    return lambda t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")


def test_encoder_equals_the_library(ids):
    import random

    random.seed(5)
    odd = ["don't stop 's 're", "I'LL x²½ Ⅷ a\x1cb", "é ñ Ñ İstanbul ǅ ß", "<|endoftext|> a<|startoftext|>b", "", "   ", "\x00 a\x00b", "日本語テキスト 👍🏽 ok", "a_b-c__d 12ab34", "ſ K Å", "ab　c", "a​c\u0085d"]
    odd += ["".join(random.choice("ab'st rel!?.,12 éÉßĳǄ\n\t²x́'d ") for _ in range(random.randint(0, 40))) for _ in range(500)]
    for t, got in zip(odd, tokens.encoder(tokens.default_tokenizer()).encode(odd)):
        assert got.tolist() == ids(t).tolist(), t


def test_encoder_on_letters_that_lower_beyond_the_plain_ones(ids):
    texts = ["Əli Ɓa aƁb", "ȺȾ xȺ", "İstanbul!", "aİ!?İ.b", *(f"a{chr(c)}b {chr(c)}!{chr(c)} 1{chr(c)}" for c in range(0xC0, 0x250))]
    for t, got in zip(texts, tokens.encoder(tokens.default_tokenizer()).encode(texts), strict=True):
        assert got.tolist() == ids(t).tolist(), t


def test_encoder_in_pieces(ids, monkeypatch):
    import random

    random.seed(6)
    monkeypatch.setattr(tokens, "PIECE", 8)
    texts = ["", "  ", "\n", "x" * 100, "7" * 50, "a.B!" * 30, "İ." * 9, "", "naïve #1 İ! ok", "don't", "", *("".join(random.choice("ab cD.,1\n\té") for _ in range(random.randint(0, 60))) for _ in range(200))]
    got = tokens.WordEncoder(tokens.default_tokenizer()).encode(texts)
    assert [g.tolist() for g in got] == [ids(t).tolist() for t in texts]
    assert tokens.WordEncoder(tokens.default_tokenizer()).encode([]) == []


def test_parts_in_use_are_learnt_once(ids, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    encoder, learnt = tokens.WordEncoder(tokens.default_tokenizer()), []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda todo: (learnt.extend(todo), learn(todo))[1])
    letters = "abcdefghij"
    for i in range(40):
        text = "the " + " ".join(f"w{letters[i // 10]}{letters[i % 10]}{x}" for x in letters)
        assert encoder.encode([text])[0].tolist() == ids(text).tolist()
    assert sum(p in ("the", b"the") for p in learnt) == 1
    assert len(encoder.parts) + len(encoder.older) <= 2 * (50 + 12)  # a generation, and what one piece adds


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_token_files(spark, request, table, ids):
    files = token_store.write(request.getfixturevalue(table), token_store.folder_for(spark), file_ids=10_000)
    got = sorted(token_store.read(files).collect(), key=lambda r: r["start"])
    assert files.count() > 1
    assert [-(2**63) if r["doc_id"] is None else r["doc_id"] for r in got] == sorted(key(r)[0] for r in TEXTS)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    want = sorted(str((i, zlib.crc32(ids(t).tobytes()), len(ids(t)))) for i, t in TEXTS)
    assert want == sorted(str((r["doc_id"], r["ids_crc32"], r["n_tokens"])) for r in got)


def test_variable_bytes():
    v = np.array([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7, 9], np.uint32)
    for n in range(len(v) + 1):
        control, data = token_store.encode(v[:n])
        assert (token_store.decode(control, data, n) == v[:n]).all() and len(control) == -(-n // 4)
    assert len(token_store.encode(v[:3])[1]) == 3  # one byte each


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_packing_covers_every_id_once(request, table, ids):
    got = packing.pack(request.getfixturevalue(table), block=5000).collect()
    by, full = {}, {}
    for r in got:
        by.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"], r["ids_crc32"]))
        full.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["tier"]))
    for pieces in full.values():
        at = 0
        for offset, n, tier in sorted(pieces):
            assert offset == at
            at += n
        assert at == tier <= 4096 and at & (at - 1) == 0
    texts = {}
    for i, t in TEXTS:
        texts.setdefault((i, len(ids(t))), []).append(ids(t))
    assert set(by) == set(texts)
    for k, pieces in by.items():
        if len(texts[k]) == 1:
            at = 0
            for start, n, crc in sorted(pieces):
                assert start == at and crc == zlib.crc32(texts[k][0][at : at + n].tobytes())
                at += n
            assert at == k[1]


def test_step_groups_are_even():
    sizes = [4096] * 20 + [2048] * 31 + [1024] * 17 + [512] * 9
    groups = packing.step_groups(sizes)
    total = {}
    for s, g in zip(sizes, groups):
        total[g] = total.get(g, 0) + s
    assert max(total.values()) - min(total.values()) <= 4096 and max(total.values()) <= packing.STEP + 4096


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_sentence_pieces_come_back(request, table):
    got = sentencepieces.encode_decode(request.getfixturevalue(table), keep=True).collect()
    assert all(r["round_trip"] for r in got)
    want = sorted(str((i, (t or "").replace("▁", " "))) for i, t in TEXTS)
    assert want == sorted(str((r["doc_id"], r["decoded"])) for r in got)


def test_viterbi_equals_the_lattice_of_the_library():
    """The model's scores in the library's own best-path search (its type set to unigram)."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    path = sentencepieces.default_model()
    m = proto.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        p.score = max(p.score, -90000.0)  # the library sums 32-bit floats, and a few pieces stand at -1e9
    library, own = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString()), sentencepieces.pieces(path)
    for w in "the quick brown foxes, jumping over lazily-sleeping dogs; internationalisation! Straße élève (2024) aaaaaaa".split():
        assert own.encode(w).tolist() == library.encode(w), w


def test_viterbi_brute_force():
    p = sentencepieces.pieces(sentencepieces.default_model())
    score = {piece: v[1] for piece, v in ((x, p.automaton.get(x)) for x in p.automaton)}

    def best(t):
        if not t:
            return 0.0
        return max((score[t[:n]] + best(t[n:]) for n in range(1, len(t) + 1) if t[:n] in score), default=-np.inf)

    for w in ("▁winding", "▁theories", "▁abcabc"):
        got = sum(score[x] for x in (p.bytes_of[i].decode().replace(" ", "▁") for i in p.best(w)))
        assert got == best(w)


@pytest.mark.parametrize("run", [fingerprints.fingerprint, packing.pack, sentencepieces.encode_decode], ids=["fingerprint", "pack", "pieces"])
def test_empty_tables(none, run):
    assert run(none).count() == 0


def test_empty_tables_with_files(spark, none):
    assert token_store.read(token_store.write(none, token_store.folder_for(spark))).count() == 0
    assert media.load(spark, media.store(none, media.folder_for(spark))).count() == 0
