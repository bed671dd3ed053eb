"""Operators on single texts against plain versions, and what they make of odd tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetaudit.llm import fingerprints, packing, personal_data, piece_encoding, simhash, subwords, token_files

WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
RANDOM = random.Random(5)
SPACES = "\t\n\x0b\x0c\r\x1c \x85\xa0 　"
ODD = ["", " ", "a", " a", "a ", "  a  b ", "\n", "a\n b", "▁x", "<s>x</s>", "<0x0A>", "\0a", "Ａﬁ ½", "é é", "\U0001F600日本",
       "a\r\n\r\nb", "<|endoftext|> a<|endoftext|>b  <|startoftext|>", "don't WE'LL 'tis", "ΑΣ İi ß ÀÉ.", "x" * 3000, " " * 300,
       "ab" * 2000, "c,,, d!!!!!! |x| %y%"]
ODD += ["".join(RANDOM.choice(SPACES + "aAbé1.,!'<|>st") for _ in range(RANDOM.randrange(40))) for _ in range(400)]
ODD += ["".join(RANDOM.choice("  abcdetheinrsou▁é日\n") for _ in range(RANDOM.randrange(120))) for _ in range(400)]


def table(spark, texts, first=0):
    """doc_id, text and columns whose names operators use themselves."""
    rows = [(None if i == 3 else first + i, t, "x", 1.5, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, score double, text_key string").repartition(3)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_word_encoder_equals_the_library(path):
    mine, library = subwords.WordEncoder(path, limit=50), Tokenizer.from_file(path)
    for text, ids in zip(ODD, mine.encode(ODD)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_piece_encoder_equals_the_library():
    mine, library = piece_encoding.PieceEncoder(PIECE, limit=50), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for text in ODD:
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert mine.encode(text).tolist() == ids, text
        assert mine.decode(np.array(ids)) == library.decode(ids)
    assert mine.decode(np.array([0, 5])) == library.decode([0, 5])


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31, 32])
def test_bit_packing_round_trip_and_random_access(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000, dtype=np.uint64).astype("<u4")
    payload = token_files.pack(ids, bits, per_block=64)
    assert (token_files.unpack(payload) == ids).all()
    for start, stop in ((0, 1), (63, 65), (500, 900), (999, 1000), (5, 5), (990, 2000)):
        assert (token_files.unpack(payload, start, stop) == ids[start:stop]).all()
    assert len(payload) <= 17 + 8 * 16 + 16 * -(-64 * bits // 8)
    assert len(token_files.unpack(token_files.pack(ids[:0], bits))) == 0
    if bits < 32:
        with pytest.raises(ValueError):
            token_files.pack(np.array([1 << bits], "<u4"), bits)
    assert token_files.bits_for(49_408) == 16 and token_files.bits_for(65_537) == 17 and token_files.bits_for(1) == 1


def test_token_files_hold_every_document(spark, tmp_path):
    texts = [None if i == 7 else t for i, t in enumerate(ODD[:120])] + ODD[:5]
    token_files.write_token_files(table(spark, texts), str(tmp_path / "t"), WORD, 1, 49_408, frame_ids=200)
    got = token_files.document_ids(token_files.read_token_files(spark, str(tmp_path / "t"))).collect()
    library = Tokenizer.from_file(WORD)
    want, start = [], 0
    rows = sorted(((None if i == 3 else i), t or "") for i, t in enumerate(texts) if i != 3)
    for key, text in [(None, texts[3]), *rows]:
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [1], "<u4")
        want.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_token_files_of_an_empty_table(spark, tmp_path):
    token_files.write_token_files(table(spark, ["a"]).where("false"), str(tmp_path / "t"), WORD, 1, 49_408)
    assert token_files.document_ids(token_files.read_token_files(spark, str(tmp_path / "t"))).count() == 0


def test_piece_encoding_of_a_table(spark):
    texts = [None, "", "a b", "a b", *ODD[20:40]]
    docs = table(spark, texts)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = {r["doc_id"]: r for r in piece_encoding.round_trip(docs, PIECE).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        row = rows[None if i == 3 else i]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    decoded = piece_encoding.decode_documents(piece_encoding.encode_documents(docs, PIECE), PIECE)
    assert {r["doc_id"]: r["text"] for r in decoded.collect()} == {
        None if i == 3 else i: library.decode(library.encode(t or "")) for i, t in enumerate(texts)}
    assert piece_encoding.round_trip(docs.where("false"), PIECE).count() == 0


def shingles(text):
    words = text.lower().split()
    n = min(5, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set()


def test_fingerprints_of_edited_texts(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(RANDOM.choices(words, k=RANDOM.choice([0, 1, 3, 30, 900]))) for _ in range(60)] + [None, "", "é" * 9, "é" * 9]
    texts[10] = texts[11] = " ".join(words)
    rows = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(table(spark, texts), k=512).collect()}
    assert len(rows) == len(texts)
    order = [3, *(i for i in range(len(texts)) if i != 3)]
    for at, i in enumerate(order):
        text, after = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        quarter = len(text) // 4
        edited = text[:len(text) - quarter] + after[:quarter]
        row = rows[None if i == 3 else i]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingles(text), shingles(edited), shingles(after)
        assert abs(row["near_edited"] - (len(a & b) / len(a | b) if a | b else 1)) < 0.12
        assert abs(row["near_next"] - (len(a & c) / len(a | c) if a | c else 1)) < 0.12
        assert abs(row["n_shingles"] - len(a)) <= 0.25 * len(a)
        assert abs(row["kept"] - (len(a & b) / len(a) if a else 1)) < 0.15
    assert rows[10]["fingerprint"] == rows[11]["fingerprint"] != rows[9]["fingerprint"]
    one = fingerprints.edited_fingerprints(table(spark, ["a b c d e f g h"], 9)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprints.edited_fingerprints(table(spark, ["a"]).where("false")).count() == 0


def test_sketches_merge(spark):
    words = [f"w{i}" for i in range(3000)]
    whole = " ".join(words)
    parts = [" ".join(words[lo:lo + 504]) for lo in range(0, 3000, 500)]
    merged = np.empty(0, np.int64)
    for part in parts:
        merged = fingerprints.merge(merged, fingerprints.sketch(part))
    assert (merged == fingerprints.sketch(whole)).all()
    assert (fingerprints.from_text(fingerprints.to_text(merged)) == merged).all()
    assert abs(fingerprints.distinct_count(merged) - 2996) < 900
    half = fingerprints.sketch(" ".join(words[:1500]))
    assert abs(fingerprints.resemblance(merged, half) - 0.5) < 0.15 and fingerprints.containment(half, merged) > 0.8
    docs = spark.createDataFrame([(i, "k" if i else None, t) for i, t in enumerate(parts + [None])], "doc_id long, key string, text string")
    sketched = fingerprints.document_sketches(docs).join(docs.select("doc_id", "key"), "doc_id")
    got = {r["key"]: r["hashes"] for r in fingerprints.merge_parts(sketched.where("key is not null"), "key").collect()}
    rest = np.empty(0, np.int64)
    for part in parts[1:]:
        rest = fingerprints.merge(rest, fingerprints.sketch(part))
    assert got == {"k": rest.tolist()}


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + n]).encode(), 42) for i in range(len(words) - n + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_of(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def near_texts(n):
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(n):
        if texts and RANDOM.random() < 0.6:
            base = (RANDOM.choice(texts) or "").split()
            for _ in range(RANDOM.randrange(3)):
                if base:
                    base[RANDOM.randrange(len(base))] = RANDOM.choice(words)
            texts.append(" ".join(base))
        else:
            texts.append(" ".join(RANDOM.choices(words, k=RANDOM.choice([0, 1, 2, 40, 150]))))
    return texts


def test_simhash_components_are_exact(spark):
    texts = near_texts(250) + [None, "", " \t\n", "A B C", "a b c", " ", "日本 É"]
    rows = simhash.near_duplicates(table(spark, texts)).collect()
    assert len(rows) == len(texts)
    prints = [plain_simhash(t or "") for t in texts]
    root = roots_of(len(texts), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    least = {}
    for i, r in enumerate(root):
        if i != 3:
            least.setdefault(r, i)
    for row in rows:
        i = 3 if row["doc_id"] is None else row["doc_id"]
        assert row["fingerprint"] == f"{prints[i]:016x}"
        assert row["component_id"] == least.get(root[i])
    assert simhash.near_duplicates(table(spark, ["a"]).where("false")).count() == 0


def test_simhash_chunks_of_a_long_list_lose_no_link(spark):
    center = 0x0123456789ABCDEF
    prints = [center] + [center ^ (1 << RANDOM.randrange(64)) ^ (1 << RANDOM.randrange(64)) for _ in range(300)]
    prints += [center ^ (0b111111 << (8 * k)) for k in range(8)] + [RANDOM.getrandbits(64) for _ in range(100)]
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), chunk=16).collect()
    at = {p: i for i, p in enumerate(signed)}
    pairs = {frozenset((at[r["a"]], at[r["b"]])) for r in links}
    assert all((prints[a] ^ prints[b]).bit_count() <= 3 for a, b in map(tuple, pairs))
    assert roots_of(len(prints), lambda a, b: frozenset((a, b)) in pairs) == roots_of(
        len(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)


def test_blocks_cover_any_three_positions():
    blocks = simhash.blocks()
    assert len(blocks) == 14
    for a in range(8):
        for b in range(8):
            for c in range(8):
                assert any(not {a, b, c} & set(block) for block in blocks)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    def stays(kind, m):
        digits = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]

    return [(k, m.start(), m.end()) for k, r in BASE.items() for m in re.finditer(r, text, re.ASCII) if stays(k, m[0])]


PERSONAL = ["", None, "a@b.c+d@e.f", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1 0001.2.3.4", "+1 (017) 555-7713.", "+12345678",
            "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112", "1 - 2  4111 1111 1111 1111 1", "日本 x@y.zz é +33 1 23 45 67 89 é",
            "a.a.a@" + "b." * 20000 + "c", "9" * 200_000, "a" * 200_000, "1.1.1.1 " * 3000, "+1" + "2 " * 100_000, "a@b" * 2000,
            "+" * 5000 + "1234567890", "x@" * 20000, "john [at] mail [dot] com", "call (212) 555-7713 now"]
for alphabet, n in (("ab@. +-19()", 300), ("14 -", 200), ("1.25 ", 300), ("+1 ().-a", 200)):
    PERSONAL += ["".join(RANDOM.choice(alphabet) for _ in range(RANDOM.randrange(60))) for _ in range(n)]


def test_base_spans_equal_the_plain_patterns(spark):
    rows = personal_data.find_personal_data(table(spark, PERSONAL)).collect()
    assert len(rows) == len(PERSONAL)
    for row in rows:
        i = 3 if row["doc_id"] is None else row["doc_id"]
        want = base_spans(PERSONAL[i] or "")
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert row["base_sha256"] == hashlib.sha256(written.encode()).hexdigest(), PERSONAL[i][:80]
        assert [row[f"n_{k}"] for k in BASE] == [sum(w[0] == k for w in want) for k in BASE]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(row["spans"].split(","))
    assert personal_data.find_personal_data(table(spark, ["a"]).where("false")).count() == 0


def test_loose_spans_are_judged(spark):
    """Phone numbers without a country code are taken, card-length numbers that fail their checksum are not."""
    texts = [f"call +1 (212) 555-{i:04d} today" for i in range(60)] + [f"call me: (212) 555-{i:04d} today" for i in range(20)]
    texts += [f"order {4111111111111112 + 10 * i} sent" for i in range(60) if not luhn(str(4111111111111112 + 10 * i))]
    texts += ["card 4111 1111 1111 1111 ok"] * 30
    rows = personal_data.find_personal_data(table(spark, texts)).collect()
    added = {texts[3 if r["doc_id"] is None else r["doc_id"]] for r in rows if r["n_added"]}
    assert added == set(texts[60:80])


def test_the_left_border_is_a_feature(spark):
    rows = spark.createDataFrame([("a ", "."), ("a(", "."), ("a ", "!"), ("", "x")], "before string, after string")
    votes = F.array(*(F.lit(0) for _ in range(5)))
    got = rows.select(F.array(*personal_data._features(F.lit(False), F.lit("555 1234"), F.col("before"), F.col("after"), votes)).alias("f"))
    found = [r["f"] for r in got.collect()]
    assert all(len(f) == personal_data.N_FEATURES and max(f) < personal_data.N_VALUES for f in found)
    assert found[0] != found[1] and found[0] == found[2] and found[3] != found[0]


def test_masking(spark):
    texts = ["mail a@b.co now +1 212 555 7713", None, "", "none here", "4111 1111 1111 1111", "x 1.2.3.4 y 1.2.3.4"]
    docs = table(spark, texts)
    got = personal_data.mask_personal_data(docs)
    assert got.columns == docs.columns
    assert {r["text"] for r in got.collect()} == {"mail [EMAIL] now [PHONE]", None, "", "none here", "[CARD]", "x [IP] y [IP]"}


def test_estimation_finds_the_unreliable_labeler():
    """A labeler that votes at random ends near even odds, one that agrees with the others near certainty."""
    patterns = {}
    for _ in range(2000):
        true = RANDOM.random() < 0.5
        votes = [2 if true else 1, 2 if true == (RANDOM.random() < 0.95) else 1, 2 if true == (RANDOM.random() < 0.9) else 1, 0,
                 RANDOM.choice([1, 2])]
        code = 0
        for v in votes:
            code = code * 3 + v
        patterns[code] = patterns.get(code, 0) + 1
    _, rates = personal_data.estimate([(0, c, n) for c, n in patterns.items()])
    assert rates["email", "valid"][0] > 0.9 > 0.1 > rates["email", "valid"][1]
    assert abs(rates["email", "border"][0] - rates["email", "border"][1]) < 0.2


def check_packing(rows, texts, capacity):
    library, by_sequence, by_doc = Tokenizer.from_file(BYTE), {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    total = 0
    for i, text in enumerate(texts):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        own = sorted(by_doc[None if i == 3 else i], key=lambda r: r["piece"])
        start = 0
        for n, r in enumerate(own):
            assert (r["piece"], r["start"]) == (n, start) and (n == 0 or r["length"] == capacity)
            assert r["ids_crc32"] == zlib.crc32(ids[start:start + r["length"]].tobytes())
            start += r["length"]
        assert start == len(ids) and (len(own) == 1 or len(ids) > capacity)
        total += len(ids)
    return len(by_sequence), -(-total // capacity)


def test_packing_places_every_piece_once(spark):
    texts = [" ".join(RANDOM.choices(["the", "of", "and", "xyzzy"], k=RANDOM.choice([0, 1, 5, 20, 60, 300]))) for _ in range(200)] + [None, ""]
    rows = packing.pack_documents(table(spark, texts), BYTE, 0, capacity=64).collect()
    used, least = check_packing(rows, texts, 64)
    assert used <= least + max(2, least // 50)
    assert packing.pack_documents(table(spark, ["a"]).where("false"), BYTE, 0, capacity=64).count() == 0


def test_plan_covers_the_histogram_exactly():
    for seed in range(6):
        rng = random.Random(seed)
        histogram = {rng.randint(1, 100): rng.choice([1, 3, 50, 4000]) for _ in range(rng.choice([1, 5, 60]))}
        configs = packing.plan(histogram, 100)
        held = {}
        for config, count in configs:
            assert count > 0 and sum(s * n for s, n in config.items()) <= 100
            for s, n in config.items():
                held[s] = held.get(s, 0) + n * count
        assert held == histogram
        least = -(-sum(s * n for s, n in histogram.items()) // 100)
        big = sum(n for s, n in histogram.items() if s > 50)
        assert sum(n for _, n in configs) <= 1.25 * max(least, big) + 2
    assert packing.plan({}, 100) == []
    with pytest.raises(ValueError):
        packing.plan({101: 1}, 100)


def test_best_configuration_is_optimal():
    for seed in range(30):
        rng = random.Random(seed)
        prices = np.full(13, -np.inf)
        for s in rng.sample(range(1, 13), 4):
            prices[s] = rng.random()

        def best(room):
            return max([0.0, *(prices[s] + best(room - s) for s in range(1, room + 1) if prices[s] > 0)])

        counts = packing.best_configuration(prices)
        assert sum(s * n for s, n in enumerate(counts)) <= 12
        assert abs(sum(prices[s] * n for s, n in enumerate(counts) if n) - best(12)) < 1e-9
