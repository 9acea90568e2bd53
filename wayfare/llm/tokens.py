"""Token ids of whole texts from the public byte-level BPE file, with a bounded memory of space-delimited words."""

from __future__ import annotations

import os

import numpy as np

from wayfare.llm.common import CACHES

#: Bytes of words and ids that a worker remembers, about; the memory starts anew beyond it.
REMEMBERED = 96 << 20
#: Bytes that a remembered word takes beside its own and its ids'; and characters beyond which a word is not remembered.
ENTRY, LONG = 160, 64
PLAIN = "plain:"

_tokenizers: dict[str, object] = {}
_memories: dict[str, dict[str, bytes | None]] = {}
_held: dict[str, int] = {}
_sizes: dict[str, np.ndarray] = {}
_specials: dict[str, list[str]] = {}
CACHES.setdefault("tokens", []).extend([_memories, _held])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer(path: str):
    """The tokenizer of a file; of a path with PLAIN before it, one that takes the strings of added tokens for plain text."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path.removeprefix(PLAIN))
        _tokenizers[path].encode_special_tokens = path.startswith(PLAIN)
    return _tokenizers[path]


def specials(path: str) -> list[str]:
    """The strings that the file lists as added tokens: each is one token wherever it stands in a text."""
    if path not in _specials:
        _specials[path] = [] if path.startswith(PLAIN) else sorted(t.content for t in tokenizer(path).get_added_tokens_decoder().values())
    return _specials[path]


def _ids(path: str, text: str) -> bytes:
    return np.array(tokenizer(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _lengths(path: str) -> np.ndarray:
    """The bytes of each token: a byte-level vocabulary writes one character for each."""
    if path not in _sizes:
        vocabulary = tokenizer(path).get_vocab()
        _sizes[path] = np.zeros(max(vocabulary.values()) + 1, np.int64)
        _sizes[path][list(vocabulary.values())] = [len(token) for token in vocabulary]
    return _sizes[path]


def _learn(path: str, memory: dict[str, bytes | None], new: set[str]) -> None:
    """Ids of each word with a space before it, or with the line end that it begins with.

    Words without white space at either end are encoded in one text.
    """
    plain: dict[str, set[str]] = {" ": {word for word in new if word.isalnum()}, "\n": set()}
    ended = []
    for word in new.difference(plain[" "]):
        lead = "\n" if word[:1] == "\n" else " "
        bare = word[1:] if lead == "\n" else word
        if not bare or bare[0].isspace():
            memory[word] = None  # where white space runs together, words can't be cut apart
        elif bare[-1].isspace():
            memory[word] = _ids(path, lead + bare)
        elif bare[-1] in ".," and bare[:-1].isalnum():  # always cut before such a mark
            ended.append(word)
            if word[:-1] not in memory:
                plain[lead].add(bare[:-1])
        else:
            plain[lead].add(bare)
    for lead, words in plain.items():
        mark, every = lead.strip(" "), list(words)
        for low in range(0, len(every), 2000):
            part = every[low : low + 2000]
            text = lead + lead.join(part)
            (found,) = tokenizer(path).encode_batch_fast([text], add_special_tokens=False)
            ids, data = np.array(found.ids, "<u4"), text.encode()
            leads = np.flatnonzero(np.frombuffer(data, np.uint8) == ord(lead))  # no word has one inside
            ends = np.cumsum(_lengths(path)[ids])  # of tokens, in bytes
            cuts = (4 * (np.searchsorted(ends, np.append(leads[1:], len(data)), "left") + 1)).tolist()
            raw = ids.tobytes()
            memory.update(zip([mark + word for word in part] if mark else part, [raw[i:j] for i, j in zip([0, *cuts], cuts)], strict=True))
    marks = {mark: _ids(path, mark) for mark in ".,"}
    for word in ended:
        memory[word] = memory[word[:-1]] + marks[word[-1]]


def encode(texts: list[str], path: str, plain: bool = False) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text, the same as the tokenizer gives for the whole text.

    A line end between two words is a pre-token of its own, so words are cut there as well as at spaces. The first
    word is taken as if a line end stood before it, whose one token is then left out, unless the text begins with a
    space and a word. A text that holds an added
    token's string is encoded whole, or, if `plain`, as any other.
    """
    path = PLAIN + path if plain else path
    memory = _memories.setdefault(path, {})
    if _held.get(path, 0) > REMEMBERED:
        memory.clear()
        _held[path] = 0
    marks = specials(path)
    spaced = [text[:1] == " " and not text[1:2].isspace() and len(text) > 1 for text in texts]
    words = [None if any(m in text for m in marks) else (text[1:] if own else "\n" + text).replace("\n", " \n").removeprefix(" ").split(" ") for text, own in zip(texts, spaced, strict=True)]
    new = set().union(*(w for w in words if w is not None)).difference(memory)
    _learn(path, memory, new)
    known, lead = memory.__getitem__, len(_ids(path, "\n"))
    out = []
    for text, parts, own in zip(texts, words, spaced, strict=True):
        try:
            out.append(_ids(path, text) if parts is None else b"".join(map(known, parts))[0 if own else lead :])
        except TypeError:  # a word of None: white space runs together somewhere
            out.append(_ids(path, text))
    for word in [word for word in new if len(word) > LONG]:
        new.remove(word)
        memory.pop(word, None)
        if len(word) > LONG + 1:  # what `_learn` put beside it
            memory.pop(word[:-1], None)
    found = [ids for ids in map(memory.get, new) if ids]
    _held[path] = _held.get(path, 0) + ENTRY * len(new) + sum(map(len, new)) + sum(map(len, found))
    return out
