"""Replies: polishing, clamping, extraction from passages and prompts. Pure functions."""

from __future__ import annotations

import re
from functools import lru_cache

from ..config import DEFAULTS
from . import chemistry

#: Words that glued text is made of.
SEGMENT_WORDS = sorted("respectively therefore according indicates passage sulfate sulphate aqueous solution copper react metal zinc salt form that this with from which when were been have into than then also and the for are was of to in is on as by or an at a".split(), key=lambda w: -len(w))
PASSAGE = r"passage\s*\[\d+\]\s*[,:.\-–—]?\s*"
#: What is replied where nothing is found, and what ends a model's turn.
NO_CONTEXT_REPLY = "I couldn't find information about that in the loaded study material."
STOPS = ["<|im_end|>", "<|endoftext|>", "<|im_start|>", "<|startoftext|>"]
RAG_RULES = "Answer from the passages only. Keep it short and factual. If the passages do not hold the answer, say so."
NO_CONTEXT_RULES = "You have no passages for this question. Say that the study pack does not cover it."
PASSAGE_CHARS, LATER_PASSAGE_CHARS, QUERY_CHARS = (900, 700, 500), 400, 200

_MATH = re.compile(r"(\$\$[\s\S]+?\$\$|\$[^$\n]+\$)")


def segment_run(run: str) -> str:
    """A glued run as words, if known words make up all of it and the first has over two letters; else the run."""
    low = run.lower()

    @lru_cache(maxsize=None)
    def ends(at: int) -> tuple[int, ...] | None:
        if at == len(low):
            return ()
        for w in SEGMENT_WORDS:
            if low.startswith(w, at) and (at or len(w) > 2):
                rest = ends(at + len(w))
                if rest is not None:
                    return (at + len(w), *rest)
        return None

    cuts = ends(0) if len(run) >= 12 else None
    if not cuts or len(cuts) < 2:
        return run
    return " ".join(run[a:b] for a, b in zip((0, *cuts), cuts))


def restore_spaces(text: str) -> str:
    """Spaces after marks and brackets, and in long runs of glued words."""
    s = re.sub(r"([.,:;!?\])])([A-Za-z])", r"\1 \2", text)
    s = re.sub(r"([A-Za-z])(\[)", r"\1 \2", s)
    s = re.sub(r"([a-z])([A-Z][a-z]?(?:\d|\(|\^))", r"\1 \2", s)
    tokens = s.split()
    glued = any(re.fullmatch("[A-Za-z]{16,}", t) for t in tokens) or (0 < len(tokens) <= 6 and sum(map(len, tokens)) / len(tokens) >= 14)
    keep = lambda run: len(re.findall("[A-Z]", run)) > 1 or (not glued and len(run) < 18)
    s = re.sub("[A-Za-z]{12,}", lambda m: m[0] if keep(m[0]) else segment_run(m[0]), s)
    return re.sub(r"[ \t]+", " ", s).strip()


def join_ion_charges(text: str) -> str:
    s = re.sub(r"([A-Z][a-z]?)\s*[\r\n]+\s*(\d+)\s*[\r\n]*\s*([+-])", r"\1\2\3", text)
    return re.sub(r"([A-Z][a-z]?)\s+(\d+)\s*([+-])(?!\d)", r"\1\2\3", s)


def strip_passage_prefix(text: str) -> str:
    s = re.sub(rf"^(?:according\s+to\s+)?{PASSAGE}", "", text, flags=re.I)
    s = re.sub(rf"\baccording\s+to\s+{PASSAGE}", "", s, flags=re.I).strip()
    return s[0].upper() + s[1:] if "a" <= s[:1] <= "z" else s


def drop_incomplete_math(text: str) -> str:
    """Without a formula that is cut off at the end, or a sign that waits for one."""
    s = text.strip()
    if s.count("$") % 2:
        s = s[: s.rindex("$")].rstrip()
    for tail in (r"\$?\\(?:ce|pu)\{(?:[^{}]|\{[^}]*\})*\Z", r"\$\\(?:ce|pu)\{[^$]*\Z", r"\s*(?:\+|<->|<-|->)\s*\Z"):
        s = re.sub(tail, "", s).rstrip()
    return re.sub(r"[ \t]+", " ", s).strip()


def _superscripts(text: str) -> str:
    s = re.sub(r"\^{([^}]*)}", lambda m: "^{" + re.sub(f"[{chemistry.DASHES}]", "-", m[1]).strip() + "}", text)
    return re.sub(r"\^\*|\^\{\s*\*\s*\}", "", re.sub(r"\)\s*\^\s*(?:\{\s*\*\s*\}|\*)", ")", s))


def _units(text: str) -> str:
    unit = lambda m: "$\\pu{" + re.sub(r"\s+", " ", m[0]).strip() + "}$"
    return "".join(x if i % 2 else re.sub(r"(?i)\b(\d+(?:\.\d+)?\s+)?mol\s*dm\^\{-?\d+\}", unit, x, flags=re.ASCII) for i, x in enumerate(re.split(r"(\$[^$]+\$)", text)))


def polish(text: str) -> str:
    """A reply made readable: spaces, prefixes, charges, units, formulas; one line."""
    if not text.strip():
        return text
    one_line = lambda s: re.sub(r"\s+", " ", s).strip()
    steps = [
        join_ion_charges, one_line, chemistry.strip_spurious,
        lambda s: re.sub(r"(?i)^reproduce\s+this\s+formula:\s*", "", s).strip(),
        restore_spaces, strip_passage_prefix, _superscripts, chemistry.normalize_charges,
        lambda s: re.sub(r"(?i)(\^{[^}]+})\s+\((aq|s|l|g)\)", r"\1(\2)", s),
        lambda s: re.sub(r"([A-Z][a-z]?(?:\d+)?)\s+\((aq|s|l|g)\)", r"\1(\2)", s),
        _units, chemistry.normalize_in_text, chemistry.strip_spurious, chemistry.dedupe_adjacent, one_line, drop_incomplete_math,
    ]
    for step in steps:
        text = step(text)
    return text


def sentences_keeping_math(text: str) -> list[str]:
    """Sentences, whose ends don't count inside $...$."""
    out, held = [], ""
    for i, part in enumerate(_MATH.split(text)):
        if i % 2:
            held += part
            continue
        at = 0
        for m in re.finditer(r"[.!?](?=\s|\Z)", part):
            out.append((held + part[at : m.end()]).strip())
            held, at = "", m.end()
        held += part[at:]
    return [s for s in (*out, held.strip()) if s]


def tokens_keeping_math(text: str) -> list[str]:
    """Words, with $...$ as one each."""
    return [w for i, part in enumerate(_MATH.split(text)) for w in ([part] if i % 2 else part.split())]


def trim_repetition(text: str) -> str:
    """Up to the first sentence that has been said before."""
    seen: set[str] = set()
    out = []
    for s in sentences_keeping_math(text):
        key = re.sub(r"\s+", " ", s.lower().replace("$", ""))[:120]
        if key in seen:
            break
        seen.add(key)
        out.append(s)
    return " ".join(out).strip() or text.strip()


def clamp(text: str, max_sentences: int = DEFAULTS.max_reply_sentences, max_words: int = DEFAULTS.max_reply_words) -> str:
    """Polished, without repetition, and within both limits; ends with a mark or an ellipsis."""
    out = " ".join(sentences_keeping_math(trim_repetition(polish(text)))[:max_sentences]).strip()
    words = tokens_keeping_math(out)
    if len(words) > max_words:
        out = drop_incomplete_math(" ".join(words[:max_words]))
    if out and out[-1] not in ".!?…$":
        last = max(out.rfind(x) for x in ".!?")
        out = out[: last + 1] if last > 12 else out + "…"
    return drop_incomplete_math(out)


def extractive_reply(query: str, snippets: list[str], max_sentences: int = DEFAULTS.max_reply_sentences, max_words: int = DEFAULTS.max_reply_words) -> str | None:
    """Sentences of the first snippet that holds a word of the query, from the first that does; None where none has over 20 characters."""
    terms = [t for t in re.split(r"\W+", query.lower(), flags=re.ASCII) if len(t) > 2]
    for snippet in snippets if terms else []:
        text = re.sub(r"\s+", " ", snippet.strip())
        low = text.lower()
        held = [t for t in terms if t in low]
        if not held:
            continue
        sentences = [s for s in re.split(r"(?<=[.!?])\s+", text) if s]
        first = next((i for i, s in enumerate(sentences) if any(t in s.lower() for t in terms)), None)
        excerpt = "" if first is None else " ".join(sentences[first : first + max(4, max_sentences)]).strip()
        if len(excerpt) <= 20:
            at = low.index(held[0])
            start = max(0, text.rfind(" ", 0, max(0, at - 60) + 1))
            excerpt = text[start : at + max(320, max_words * 6)].strip()
        if len(excerpt) > 20:
            return clamp(excerpt, max_sentences, max_words)
    return None


def fallback_reply(snippets: list[str], max_sentences: int = DEFAULTS.max_reply_sentences, max_words: int = DEFAULTS.max_reply_words) -> str:
    """The start of the first snippet of over 24 characters."""
    best = next((s for s in snippets if len(s.strip()) > 24), None)
    if best is None:
        return NO_CONTEXT_REPLY
    text = re.sub(r"\s+", " ", best.strip())
    quoted = " ".join([s for s in re.split(r"(?<=[.!?])\s+", text) if s][: max(4, max_sentences)])
    return clamp(quoted or text[: max(280, max_words * 6)], max_sentences, max_words)


def chat_prompt(query: str, snippets: list[str]) -> str:
    """A chat prompt with numbered passages, or one that says there are none."""
    said, query = [s for s in snippets if s], query[:QUERY_CHARS]
    turn = lambda who, what: f"<|im_start|>{who}\n{what}<|im_end|>\n"
    if not said:
        return turn("system", NO_CONTEXT_RULES) + turn("user", query) + "<|im_start|>assistant\n"
    passages = "\n".join(f"[{i + 1}] {s[: PASSAGE_CHARS[i] if i < len(PASSAGE_CHARS) else LATER_PASSAGE_CHARS]}" for i, s in enumerate(said))
    asked = f"Use the following passages to answer the question. Copy relevant sentence(s) verbatim when possible.\n\n{passages}\n\nQuestion: {query}"
    return turn("system", RAG_RULES) + turn("user", asked) + "<|im_start|>assistant\n"


def format_html(text: str) -> str:
    """A polished text as HTML: escaped, line ends as breaks, math in spans for a renderer."""
    if not text:
        return ""
    escape = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    out = []
    for i, part in enumerate(_MATH.split(chemistry.prepare_for_render(polish(text)))):
        if not i % 2:
            out.append(escape(part).replace("\n", "<br />"))
            continue
        display = part.startswith("$$")
        tex = part.strip("$").strip()
        if not _balanced(tex) or re.search(r"\\ce\{[^}]*[+-]\Z", tex):
            out.append(escape(re.sub(r"^\\(?:ce|pu)\{", "", tex).strip()))
        else:
            out.append(f'<span class="math{" display" if display else ""}">{escape(tex)}</span>')
    return "".join(out)


def _balanced(tex: str) -> bool:
    depth = 0
    for x in re.findall("[{}]", tex):
        depth += 1 if x == "{" else -1
        if depth < 0:
            return False
    return not depth
