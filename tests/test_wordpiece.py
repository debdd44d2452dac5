import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import chunking, fusion
from quarry.operators.wordpiece import WordPiece, with_counts

tokenizers = pytest.importorskip("tokenizers")

PIECES = "[PAD] [UNK] [CLS] [SEP] [MASK] the th t h e un ##aff ##able ##a ##ble ##b ##le ##s ##ed play ##ing ##i ##n . , ! ? ' - ( 日 本 é ##é Be be ##st x ##x a b c don s m".split()


@pytest.fixture(scope="module")
def codec():
    return WordPiece(tuple(PIECES))


@pytest.fixture(scope="module")
def other():
    """The public library with the same vocabulary."""
    from tokenizers import Tokenizer, decoders, models, normalizers, pre_tokenizers

    made = Tokenizer(models.WordPiece({p: i for i, p in enumerate(PIECES)}, unk_token="[UNK]", max_input_chars_per_word=100))
    made.normalizer = normalizers.BertNormalizer(lowercase=False, strip_accents=False)
    made.pre_tokenizer = pre_tokenizers.BertPreTokenizer()
    made.decoder = decoders.WordPiece()
    made.add_special_tokens(["[UNK]", "[CLS]", "[SEP]", "[PAD]", "[MASK]"])
    return made


def texts():
    rng = random.Random(7)
    parts = ["the", "unaffable", "played", "playing", "plays", "best", "Best", "don't", "it's", "I'm", "x" * 101, "x" * 100, "日本", "a日b", "é", "ééé", "(the)", "\t", "\n", " ", "​", "\x00", "�", "…", "“a”", "-", "zzz", "thex", "the!", "?!", ""]
    return ["", " ", *parts, *(rng.choice(["", " "]).join(rng.choices(parts, k=rng.randrange(1, 30))) for _ in range(300)), *(" ".join(rng.choices(parts, k=40)) for _ in range(50))]


def test_ids_are_those_of_the_library(codec, other):
    for text in texts():
        assert codec.encode(text) == other.encode(text, add_special_tokens=False).ids, text


def test_decoded_text_is_that_of_the_library(codec, other):
    for text in texts():
        ids = codec.encode(text)
        assert codec.decode(ids) == other.decode(ids, skip_special_tokens=True), text


def test_columns(spark, codec):
    rows = [(i, t) for i, t in enumerate(["the unaffable best", "", "zzz", "played."])] + [(9, None)]
    df = spark.createDataFrame(rows, "id int, t string")
    got = {r.id: r for r in df.select("id", codec.ids("t").alias("ids"), codec.count("t").alias("n"), codec.text(codec.ids("t")).alias("back")).collect()}
    assert [got[i].n for i in (0, 1, 2, 3, 9)] == [6, 0, 1, 3, 0]
    assert got[0].back == "the unaffable best" and got[3].back == "played." and got[2].back == "" and got[9].ids is None


def test_vocabulary_file(spark, tmp_path, codec):
    (tmp_path / "vocab.txt").write_text("\n".join(PIECES) + "\n")
    assert WordPiece.read(spark, str(tmp_path / "vocab.txt")) == codec
    with pytest.raises(ValueError):
        WordPiece.read(spark, str(tmp_path / "vocab.txt"), most=3)
    with pytest.raises(ValueError):
        WordPiece(("a", "b"))


def test_windows_and_budget(spark, codec):
    rows = [("1", "the unaffable played best " * 700, 0.9), ("2", "the", 0.8), ("3", "", 0.7), ("4", None, 0.6)]
    df = spark.createDataFrame(rows, "id string, chunk_text string, s double")
    ids = codec.encode(rows[0][1])
    got = chunking.token_windows(df.select("id", "chunk_text"), chunking.ChunkConfig(7, 2), codec.encode, codec.decode, "chunk_text").where("id = '1'").orderBy("chunk_index").collect()
    assert [r.chunk_text for r in got] == [codec.decode(ids[a : a + 7]) for a in range(0, len(ids), 5)] and len(got) > 1024
    counted = with_counts(df, codec).withColumn("rank", F.row_number().over(fusion.Window.orderBy(F.desc("s"))))
    assert [r.tokens for r in counted.orderBy("rank").collect()] == [len(ids), 1, 0, 0]
    assert [r.id for r in fusion.within_budget(counted, 200 + len(ids)).orderBy("rank").collect()] == ["1"]


def test_decoding_equals_a_loop_over_the_ids():
    pieces = ("[UNK]", "[CLS]", "[PAD]", "a", "##a", ".", "##.", "n't", "##", "", "##'s", "'s", "bc", "##bc")
    codec = WordPiece(pieces)

    def plain(ids):
        out = []
        for i in ids:
            piece = pieces[i]
            if piece in codec.special:
                continue
            if out:
                piece = piece[2:] if piece.startswith("##") else f" {piece}"
            out.append({" .": ".", " n't": "n't", " 's": "'s"}.get(piece, piece))
        return "".join(out)

    rng = random.Random(5)
    assert codec._shown is codec._shown
    for _ in range(500):
        ids = [rng.randrange(len(pieces)) for _ in range(rng.randrange(9))]
        assert codec.decode(ids) == plain(ids)
