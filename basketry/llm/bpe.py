"""Token ids of byte-level BPE vocabularies, as the ``tokenizers`` library gives them.

For a plain byte-level BPE (no normalizer, dropout or prefix space, merges in the order of their ids) ``tiktoken`` runs the
same merges on the same pre-tokens several times faster, so it is used there; text is first cut at the vocabulary's
special strings, as ``tokenizers`` does by default. Any other ``.json`` file goes through ``tokenizers`` itself.
"""

from __future__ import annotations

import functools
import json
import os

# The pre-token pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary as ranks, if merging by lowest id is what the file asks for; else None."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    odd = spec.get("normalizer") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges")
    added = spec.get("added_tokens") or []
    if not plain or odd or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        return None
    special = {t["content"] for t in added}
    byte, vocab = _byte_of(), model["vocab"]
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged):
        return None
    return {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}


@functools.cache
def byte_level(path: str) -> bool:
    """Whether ``path`` is a plain byte-level BPE without spaces in its special strings."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return _ranks(spec) is not None and not any(" " in t["content"] for t in spec.get("added_tokens") or [])


@functools.cache
def encoder(path: str):
    """A function from a list of texts to their lists of ids, one thread; cached per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ranks = _ranks(spec)
    if ranks is None:
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        return lambda texts: [e.ids for e in lib.encode_batch_fast(texts, add_special_tokens=False)]
    import tiktoken

    special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
    lib = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(text: str) -> list[int]:
        return lib.encode(text, allowed_special="all") if any(s in text for s in special) else lib.encode_ordinary(text)

    return lambda texts: [ids(t) for t in texts]


@functools.cache
def widths(path: str) -> list[int]:
    """The bytes that each id stands for (byte-level vocabularies)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    out = {i: len(t) for t, i in spec["model"]["vocab"].items()}
    out |= {t["id"]: len(t["content"].encode()) for t in spec.get("added_tokens") or []}
    return [out.get(i, 0) for i in range(max(out) + 1)]
