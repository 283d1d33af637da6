"""Very long runs of white space and very large or small vectors."""

import numpy as np
import pytest

from touchline.llm.embedding_dups import near_duplicates
from touchline.llm.packing import LONG_BLANK, default_vocabulary, long_blank, pack, token_ids


@pytest.mark.parametrize("blank", [" ", "\n", "\t", "\r\n", "　", " \n"])
def test_three_million_blanks_are_packed(blank):
    from pathlib import Path

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(str(Path(default_vocabulary()).with_suffix(".json")))
    text = "a page" + blank * (3_000_000 // len(blank)) + "its end <|endoftext|> x"
    assert token_ids(text, default_vocabulary()).tolist() == [*library.encode(text, add_special_tokens=False).ids, 0]


def test_both_encoders_agree():
    rng = np.random.default_rng(3)
    for n in (LONG_BLANK - 3, LONG_BLANK - 2):
        text = "".join(rng.choice(list("ab \n\tcé "), 400)) + "x" + " " * n + "\n\nend"
        from touchline.llm.packing import _encoding, _plain_encoding

        path = default_vocabulary()
        assert long_blank(text) == (n == LONG_BLANK - 2)
        assert _encoding(path).encode_to_numpy(text, allowed_special="all").tolist() == _plain_encoding(path).encode(text, add_special_tokens=False).ids


def test_a_page_of_blanks_is_packed(spark):
    docs = spark.createDataFrame([(1, " " * 1_500_000), (2, "word"), (3, None)], "doc_id long, text string")
    rows = pack(docs).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3} and sum(r["length"] for r in rows if r["doc_id"] == 1) == next(r["doc_tokens"] for r in rows if r["doc_id"] == 1)


def test_vectors_whose_squares_are_out_of_range(spark):
    e = [[1e200, 1e200], [1e200, 1.01e200], [1e-200, 1e-200], [1e-310, 1e-310], [1e300, -1e300], [0.0, 0.0], [1.0, float("inf")]]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(e)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicates(df).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 4: (0, 4), 5: (0, 5), 6: (0, 6)}
