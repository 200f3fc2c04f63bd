"""Chunk assemblers: greedy by structure, semantic by likeness of sentences.

What a chunk becomes depends on those before it in its document, hence one pass
in order over each document's own sections.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame

from inkfathom.operators.ordered import by_group

#: Least tokens of a chunk, tokens it grows to, tokens it never exceeds, sections it may have.
LEAST, TARGET, HARD, SECTIONS = 900, 1300, 7900, 12
OVERLAP = 200
BREAKS = r"\b(faq|glossary|changelog|references|appendix)\b"

_OUT = (
    "document_id {id}, chunk_id string, ord bigint, level bigint, heading string, text string, token_count bigint, "
    "section_ids array<string>, is_combined boolean, is_split boolean"
)


def count(text: str) -> int:
    return len(text.split())


def chunk_key(document: object, ids: Sequence[str]) -> str:
    """One section's own id, or a hash over the document's and all ids in order."""
    return ids[0] if len(ids) == 1 else hashlib.sha256("|".join([str(document), *ids]).encode()).hexdigest()


def split_words(text: str, size: int, overlap: int) -> list[str]:
    """Windows of ``size`` words that begin ``overlap`` words before the last one's end, white space kept."""
    words = re.findall(r"\s*\S+\s*", text)
    out, at = [], 0
    while True:
        out.append("".join(words[at : at + size]).strip())
        if at + size >= len(words):
            return out
        at += max(1, size - overlap)


def blocks(levels: Sequence[int], headings: Sequence[str], breaks: str) -> list[int]:
    """Block of each section: a heading of level 1 or 2, or with a break word, begins one."""
    out, n = [], -1
    for level, heading in zip(levels, headings):
        if n < 0 or level <= 2 or re.search(breaks, heading, re.I):
            n += 1
        out.append(n)
    return out


def greedy(sections: list[dict], document: object, least: int, target: int, hard: int, most: int, breaks: str, overlap: int) -> list[dict]:
    """Sections joined within their block until the target; those of the first
    one's own level from 3 down stay apart; below ``least`` it goes on up to the
    hard limit; what exceeds that alone is split."""
    block = blocks([s["level"] for s in sections], [s["heading"] for s in sections], breaks)
    out: list[dict] = []
    i = 0
    while i < len(sections):
        seed, size, j = sections[i], count(sections[i]["text"]), i + 1
        for limit in (target, least):
            while j < len(sections) and block[j] == block[i] and j - i < most and size < limit:
                s = sections[j]
                n = count(s["text"])
                apart = s["level"] == seed["level"] >= 3 or s["level"] < seed["level"]
                if apart or re.search(breaks, s["heading"], re.I) or size + n > hard:
                    break
                size += n
                j += 1
        group = sections[i:j]
        parts = [f"{s['heading']}\n\n{s['text']}" if s["heading"] else s["text"] for s in group]
        text = "\n\n".join(p.strip() for p in parts if p.strip())
        ids = [str(s["section_id"]) for s in group]
        row = {"document_id": document, "level": min(s["level"] for s in group), "heading": seed["heading"], "is_combined": len(group) > 1}
        if count(text) <= hard:
            out.append(row | {"chunk_id": chunk_key(document, ids), "ord": seed["ord"], "text": text, "token_count": count(text), "section_ids": ids, "is_split": False})
        else:
            pieces = split_words(text, hard, min(overlap, hard // 2))
            for k, piece in enumerate(pieces):
                mark = hashlib.sha256(f"{ids}|{k}|{len(pieces)}|{count(piece)}".encode()).hexdigest()[:12]
                own = [*ids, mark]
                out.append(
                    row | {"chunk_id": chunk_key(document, own), "ord": seed["ord"] * 100_000 + k, "text": piece, "token_count": count(piece), "section_ids": own, "is_split": True}
                )
        i = j
    return out


def balance(chunks: list[dict], least: int, hard: int) -> list[dict]:
    """A chunk below ``least`` joins the one before, if that has not just been
    joined, both stand in one bucket of places, are not alike at level 3 or
    deeper, and fit the hard limit."""
    out: list[dict] = []
    i = 0
    while i < len(chunks):
        a = chunks[i]
        b = chunks[i + 1] if i + 1 < len(chunks) else None
        joins = (
            b is not None and b["token_count"] < least and a["ord"] // 100_000 == b["ord"] // 100_000
            and not a["level"] == b["level"] >= 3 and a["token_count"] + b["token_count"] <= hard
        )
        if joins:
            text = f"{a['text'].rstrip()}\n\n{b['text'].lstrip()}".strip()
            ids = list(dict.fromkeys(a["section_ids"] + b["section_ids"]))
            a = a | {"text": text, "token_count": count(text), "section_ids": ids, "is_combined": len(ids) > 1, "is_split": a["is_split"] or b["is_split"]}
        out.append(a)
        i += 2 if joins else 1
    return out


def _by_document(sections: DataFrame, assemble: Callable[[list[dict], object], list[dict]]) -> DataFrame:
    kind = sections.schema["document_id"].dataType.simpleString()

    def run(own: list[dict]) -> list[dict]:
        for s in own:
            s["text"], s["heading"] = s["text"] or "", s["heading"] or ""
            s["ord"], s["level"] = (math.nan if s[c] is None else s[c] for c in ("ord", "level"))
        return sorted(assemble(own, own[0]["document_id"]), key=lambda c: (c["ord"], c["chunk_id"]))

    need = sections.select("document_id", "section_id", "ord", "level", "heading", "text")
    return by_group(need, "document_id", ["ord", "section_id"], run, _OUT.format(id=kind))


def greedy_chunks(sections: DataFrame, least: int = LEAST, target: int = TARGET, hard: int = HARD, most: int = SECTIONS, breaks: str = BREAKS, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of sections: document_id, section_id, ord, level, heading, text."""
    return _by_document(sections, lambda s, d: balance(greedy(s, d, least, target, hard, most, breaks, overlap), least, hard))


Embedder = Callable[[Sequence[str]], np.ndarray]


def hashed_embedding(texts: Sequence[str], size: int = 64) -> np.ndarray:
    """Unit vectors of signed hashed words: an embedder without a model."""
    out = np.zeros((len(texts), size))
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            out[i, h % size] += 1 if h >> 16 & 1 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def merge_tiny(pieces: list[tuple[str, int]], least: int) -> list[tuple[str, int]]:
    """Pieces of which either is below ``least`` are joined, none is dropped."""
    out: list[tuple[str, int]] = []
    for text, n in pieces:
        if not text.strip():
            continue
        if out and (out[-1][1] < least or n < least):
            out[-1] = (f"{out[-1][0]}\n\n{text}", out[-1][1] + n)
        else:
            out.append((text, n))
    if len(out) > 1 and out[-1][1] < least:
        (a, m), (b, n) = out[-2:]
        out[-2:] = [(f"{a}\n\n{b}", m + n)]
    return out


def code_share(text: str) -> float:
    return sum(map(len, re.findall(r"(?s)```.*?```", text))) / len(text) if text else 0.0


def semantic(text: str, embed: Embedder, target: int, least: int, most: int, alike: float) -> list[tuple[str, int]]:
    """A section's pieces: code by size; else cut where a sentence is unlike the
    one before, or at the target; within guard windows of ``most`` words."""
    if code_share(text) > 0.5:
        return [(p, count(p)) for p in split_words(text, target, 0)]
    pieces: list[tuple[str, int]] = []
    for window in split_words(text, most, 0):
        sentences = [s for s in re.split(r"(?<=[.!?])\s+", window) if s.strip()]
        if not sentences:
            continue
        v = embed(sentences)
        like = np.einsum("ij,ij->i", v[1:], v[:-1])
        held, n = [sentences[0]], count(sentences[0])
        for s, near in zip(sentences[1:], like):
            if near < alike or n + count(s) > target:
                pieces.append((" ".join(held), n))
                held, n = [], 0
            held.append(s)
            n += count(s)
        pieces.append((" ".join(held), n))
    sized = [(p, count(p)) for piece, _ in merge_tiny(pieces, least) for p in split_words(piece, most, 0)]
    return sized


def semantic_chunks(
    sections: DataFrame, embed: Embedder = hashed_embedding, target: int = 350, least: int = 40, most: int = 2000, alike: float = 0.3
) -> DataFrame:
    """Each section by itself; pieces after the first have their heading marked as continued."""

    def assemble(own: list[dict], document: object) -> list[dict]:
        out: list[dict] = []
        for s in own:
            found = semantic(s["text"], embed, target, least, most, alike) if s["text"].strip() else []
            for k, (text, n) in enumerate(found):
                ids = [str(s["section_id"])] if len(found) == 1 else [str(s["section_id"]), f"part-{k}"]
                heading = s["heading"] if k == 0 or not s["heading"] else f"{s['heading']} (continued)"
                out.append(
                    {"document_id": document, "chunk_id": chunk_key(document, ids), "ord": len(out), "level": s["level"], "heading": heading, "text": text,
                     "token_count": n, "section_ids": [str(s["section_id"])], "is_combined": False, "is_split": len(found) > 1}
                )
        return out

    return _by_document(sections, assemble)


ASSEMBLERS = {"greedy": greedy_chunks, "structured": greedy_chunks, "semantic": semantic_chunks}


def assembler(kind: str = "greedy") -> Callable[..., DataFrame]:
    """By name; an unknown one is greedy."""
    return ASSEMBLERS.get(kind.strip().lower(), greedy_chunks)
