"""The packing encoder against the tokenizer, on texts whose pieces share hashes."""

import duckdb
import numpy as np
import pytest

from leadlens.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")


def thue_morse(n, x, y):
    return "".join(y if i.bit_count() % 2 else x for i in range(n))


def ids_of(tokenizer, rows):
    return [i for e in tokenizer.encode_batch(rows, add_special_tokens=False) for i in [*e.ids, packing.END_ID]]


@pytest.mark.parametrize("collide", [False, True])
def test_pieces_of_one_hash(data, monkeypatch, collide):
    """Words whose polynomial hash modulo 2**64 is one (from 1,024 letters on), and any words at all when hashes are few."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    tokenizer, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    if collide:
        monkeypatch.setattr(packing, "mix", lambda x: x % np.uint64(40))
    pairs = [thue_morse(n, *ends) for n in (32, 48, 512, 1024, 2048) for ends in ("aq", "qa")]
    given = [r[0] or "" for r in duckdb.sql(f"SELECT text FROM '{data}/documents.parquet' ORDER BY doc_id").fetchall()]
    for rows in (pairs, given[:60], pairs + given[30:90], ["", " a b  c ", "<|endoftext|> x", "x" * 48, "x" * 49, " " * 60], given):
        ids, counts = encoder.encode(rows)
        assert ids.tolist() == ids_of(tokenizer, rows)
        assert counts.tolist() == [len(e.ids) + 1 for e in tokenizer.encode_batch(rows, add_special_tokens=False)]
