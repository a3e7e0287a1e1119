"""Token counts of a byte-level BPE vocabulary by the whole-token shortcut.

Proved once per process, before any row is read: the vocabulary strings that the splitting pattern
leaves in one piece and that the merges turn into exactly one token. A pre-token among them counts one
without a merge; only the rest is merged, by the vocabulary's own merge model, and remembered in a
bounded cache.

Null text: 0 bytes, 0 tokens. Special strings inside a text count as the library's default has it:
one token each.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents
from .pretokens import splitter

CACHE = 300_000


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies (GPT-2's public rule)."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


@lru_cache(2)
def load(path: str):
    """(pattern, merge model, byte stand-ins, proved whole tokens, special strings)."""
    import public_tokenizers
    import regex
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    pattern, chars = regex.compile(public_tokenizers.PATTERN), _byte_chars()
    special = sorted((t.content for t in tok.get_added_tokens_decoder().values()), key=len, reverse=True)
    return pattern, tok.model, chars, prove_whole(tok, pattern, chars), special


def prove_whole(tok, pattern, chars) -> dict[str, int]:
    """Vocabulary strings that encode alone as one token."""
    back, whole = {c: b for b, c in enumerate(chars)}, {}
    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    for piece in tok.get_vocab():
        if piece in special or any(c not in back for c in piece):
            continue
        try:
            word = bytes(back[c] for c in piece).decode("utf-8")
        except UnicodeDecodeError:
            continue  # a part of a character is never a pre-token
        if pattern.findall(word) == [word] and len(tok.model.tokenize(piece)) == 1:
            whole[word] = 1
    return whole


class Counts(dict):
    """pre-token -> number of tokens: the proved ones from the start, others merged on first sight."""

    def __init__(self, whole, model, chars):
        super().__init__(whole)
        self.whole, self.model, self.chars = whole, model, chars

    def __missing__(self, word: str) -> int:
        if len(self) >= len(self.whole) + CACHE:
            self.clear()
            self.update(self.whole)
        chars = self.chars
        n = len(self.model.tokenize("".join([chars[b] for b in word.encode("utf-8", "surrogatepass")])))
        if len(word) <= 64:
            self[word] = n
        return n


def count_tokens(docs: DataFrame, path: str, max_tokens: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row; one map over the scan, nothing shuffled."""

    def run(batches):
        import regex

        _, model, chars, whole, special = load(path)
        counts, cut = Counts(whole, model, chars), regex.compile("|".join(map(regex.escape, special))) if special else None
        get, find = counts.__getitem__, splitter()
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in batch.column(1).to_pylist():
                n_bytes.append(len(text.encode("utf-8", "surrogatepass")))
                if cut is not None and cut.search(text):
                    parts = cut.split(text)
                    n_tokens.append(len(parts) - 1 + sum(sum(map(get, find(p))) for p in parts))
                else:
                    n_tokens.append(sum(map(get, find(text))))
            tokens = pa.array(n_tokens, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), tokens, pa.array([n > max_tokens for n in n_tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return documents(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
