"""Broken prompt and response pairs and the kind of each defect."""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.keys import opened, sampled, sealed
from corpusmill.llm.html_text import visible_text

#: Answers on which the terminal-context model is fitted, chosen by hash; every pair is then judged.
FIT_ANSWERS = 12_288
_CELLS = 1 << 18
#: An ending recurs if so many different pairs have it and, at 95 % confidence, so large a share of all pairs with such ends.
SEEN, SHARE, _Z = 4, 0.01, 1.645

# Word lists of the six languages.
FILLERS = frozenset(
    "n/a na none null nil tbd tba tbc todo xxx xx x ? ?? - -- --- … ... . _ [answer] <answer> answer to be added to be defined "
    "to follow coming soon lorem ipsum undefined placeholder empty blank".split()
) | {"to be added", "to be defined", "to be completed", "to follow", "coming soon", "lorem ipsum", "no answer", "not available", "no answer yet", "answer pending", "pending"}
LANGUAGES = {
    "en": "the and is of to for are in that it with as at on by be not this or which who when what how do does we you from an both no should can has after before during every about",
    "de": "der die das und ist von zu für sind im dass es mit als am auf bei nicht dies oder wer wann was wie wir sie aus ein eine einer den dem des gilt vor nach während einmal kann muss welche braucht dauert",
    "fr": "le la les et est de du des pour sont dans que il elle avec au aux sur par ne pas ce cette ou qui quand quoi comment nous vous un une afin avant après pendant chaque selon combien quels doit notre",
    "es": "el la los las y es de del para son en que lo con al por no este esta o quién cuando qué cómo nosotros un una antes después durante cada según cuánto quién paga documentos necesita nuestro si",
    "pt": "o a os as e é de do da dos das para são em que com ao por não este esta ou quem quando como nós um uma antes após durante cada segundo quanto tempo demora precisa documentos nossa se no na pelo",
    "it": "il lo la i gli le e è di del della dei per sono in che con al da non questo questa o chi quando come noi un una prima dopo durante ogni secondo quanto dura documenti servono paga nostro se nel entro",
}
#: Words that end no sentence.
OPEN_WORDS = frozenset(
    "the a an and or of to for in on at by with from as that which who whose when while because so if we our your their is are was be this each every than into about "
    "der die das den dem des und oder von zu für im in am auf bei mit als dass weil obwohl wenn ein eine einen einer wir unser vor nach "
    "le la les l un une et ou de du des d pour dans que qui avec au aux sur par car si nous notre ce cette chaque est sont "
    "el los las y o del en con al por porque si un una que nuestro cada es son su "
    "os as e do da dos das em na ao com por que se um uma nossa cada são ou "
    "il lo i gli di del della dei nel con al da che se un una nostro ogni è sono".split()
)
_REFUSAL = {
    "en": (
        r"\b(?:(?:i|we)(?:'m| am| are|'re)? (?:cannot|can't|can not|could not|couldn't|won't|will not|would not|unable|not able|not permitted|not allowed|not authori[sz]ed|not in a position|not at liberty|must refuse|must decline|have to decline|decline|refuse|prefer not|would rather not|do not have access|don't have access|have no (?:opinion|answer|comment))"
        r"|i'd rather not|we'd rather not|not possible for (?:me|us)|not be appropriate for (?:me|us)|(?:does|do) not allow (?:me|us)|beyond my|beyond our|outside of what (?:i|we) may|something (?:i|we) (?:won't|cannot|can't)|us leave this one|no comment)",
        r"\b(?:answer\w*|comment\w*|discuss\w*|assist\w*|help\w*|opinion|information|respond\w*|say|tell|talk|speak|go into|disclose|advise|details|remit|unanswered|questions?)\b",
    ),
    "de": (r"\b(?:kann|können|darf|dürfen|möchte|möchten|leider|bedaure|unmöglich)\b(?=.*\b(?:nicht|keine?n?|nichts|leider)\b)", r"\b(?:beantworten|antworten|helfen|auskunft|auskünfte|äußern|kommentieren|stellung|sagen|informationen?)\b"),
    "fr": (r"\b(?:ne (?:peux|pouvons|suis|sommes|souhaite|puis)|impossible|préfère ne|préférons ne|refuse)\b", r"\b(?:répondre|aider|informations?|renseign\w+|commenter|prononcer|réponse|question)\b"),
    "es": (r"\b(?:no (?:puedo|podemos|estoy|estamos|quiero|me es posible)|prefiero no|preferimos no|imposible)\b", r"\b(?:responder|información|ayudar\w*|pronunciarme|pronunciarnos|comentar|opinar|contestar)\b"),
    "pt": (r"\b(?:não (?:posso|podemos|tenho|temos|estou|estamos|me é possível)|prefiro não|preferimos não|impossível)\b", r"\b(?:responder|informaç\w+|ajudar|comentar|pronunciar\w*|opinar)\b"),
    "it": (r"\b(?:non (?:posso|possiamo|sono|siamo|mi è possibile)|preferisco non|preferiamo non|impossibile)\b", r"\b(?:rispondere|informazion\w|aiutar\w*|commentare|pronunciarmi|esprimermi)\b"),
}
_REFUSALS = [(re.compile(a), re.compile(b)) for a, b in _REFUSAL.values()]
_COURTESY = re.compile(r"(?:is there anything else\??|thank you for your understanding\.?|please contact your local office\.?|thank you\.?)\s*$")
_WORD = re.compile(r"\w+(?:['’./:&-]\w+)*")
_NUMBERING = re.compile(r"^\s*(?:\(?\d{1,3}[.)]|[a-zA-Z][.)]|[-*•])\s+")
_LABEL = frozenset("q a re question answer frage antwort réponse respuesta pregunta resposta pergunta risposta domanda you asked faq".split())
_SENTENCE = re.compile(r"(?<!\bPvt)(?<!\bcf)(?<!\bDr)(?<!\bMr)(?<!\bMs)[.!?]+[\"'”’»)\]]*\s+(?=[^\sa-z])")
_CLOSED = re.compile(r"[.!?。！？][\"'”’»)\]]*$")
_ELLIPSIS = re.compile(r"(?:…|\.\s?\.\s?\.|\[\s?…\s?\])[\"'”’»)\]]*$")
_BROKEN_MARK = re.compile(r"(?:[,;:(\[{/&+=–—-]|\[\s?(?:\.\.\.|…)\s?\])$")


def language_of(words: list[str]) -> tuple[str | None, int]:
    """The language whose common words weigh the most, if it leads, and their number; a word counts by how few languages share it."""
    hits = dict.fromkeys(LANGUAGES, 0.0)
    common = [own for w in words if (own := _COMMON.get(w)) is not None]
    for own in common:
        weight = 1 / len(own)
        for name in own:
            hits[name] += weight
    best, second = sorted(hits.values(), reverse=True)[:2]
    name = max(hits, key=hits.__getitem__)
    number = sum(name in own for own in common)
    return (name, number) if number >= 2 and best > second else (None, number)


_COMMON = {w: tuple(n for n, own in LANGUAGES.items() if w in own.split()) for words in LANGUAGES.values() for w in words.split()}


def _fold(text: str) -> str:
    return unicodedata.normalize("NFKC", text).replace("’", "'").casefold()


def is_empty(text: str) -> bool:
    """No letter or digit, or nothing but a filler."""
    folded = " ".join(_fold(text).split())
    bare = folded.strip(" .!:;*_​﻿")
    return bare in FILLERS or folded in FILLERS or not any(c.isalnum() for c in folded)


def declines(sentence: str) -> bool:
    """By the refusal dictionary, the speaker cannot or will not speak to the question."""
    folded = _fold(sentence)
    for unable, speech in _REFUSALS:
        for match in unable.finditer(folded):
            rest = folded[match.start() :]
            if speech.search(rest) and not re.search(r"\b(?:stress|skip)\b", rest):
                return True
    return False


def is_refusal(text: str) -> bool:
    """At least half of the words, closing courtesies aside, are in sentences that decline to answer."""
    folded = _fold(text)
    if not any(unable.search(folded) for unable, _ in _REFUSALS):
        return False
    sentences = [s for s in _SENTENCE.split(text.strip()) if s]
    while len(sentences) > 1 and _COURTESY.search(_fold(sentences[-1])):
        sentences.pop()
    lengths = [len(s.split()) for s in sentences]
    return 0 < sum(lengths) <= 2 * sum(n for n, s in zip(lengths, sentences, strict=True) if declines(s))


#: An answer of which a smaller share is new to who has the question is a copy.
COPIED = 0.35


@functools.cache
def _frames():
    """Frames without magic number and checks, so that their size is that of the text."""
    import zstandard

    return zstandard.ZstdCompressionParameters(
        compression_level=3, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False
    )


def _compressed(text: bytes, dictionary: bytes | None = None) -> int:
    import zstandard

    known = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
    return len(zstandard.ZstdCompressor(compression_params=_frames(), dict_data=known).compress(text))


def new_share(question: str, answer: str) -> float:
    """Bytes that the answer takes with the question as dictionary, beyond those the question itself would take, against its bytes alone.

    0 for the question again, about 1 for what has nothing of it.
    """
    q, a = question.encode("utf-8", "surrogatepass"), answer.encode("utf-8", "surrogatepass")
    least = _compressed(q, q)
    return max(0, _compressed(a, q) - least) / max(1, _compressed(a) - least)


def is_copy(question: str, answer: str) -> bool:
    """The answer is the question once or several times, whatever its form, and next to nothing else.

    Compression with the question as dictionary decides; only answers at least half of whose
    letters are in words of the question are compressed, and a copy has hardly any other word.
    """
    wq, wa = _WORD.findall(_fold(_NUMBERING.sub("", question))), _WORD.findall(_fold(_NUMBERING.sub("", answer)))
    while wa and wa[0] in _LABEL and (not wq or wa[0] != wq[0]):
        wa = wa[1:]
    if not wq or not wa or len(wa) < 0.6 * len(wq):
        return False
    asked = set(wq)
    if 2 * sum(len(w) for w in wa if w in asked) < sum(map(len, wa)):
        return False
    times = max(1, round(len(wa) / len(wq)))
    own, single = " ".join(wa), " ".join(wq)
    if new_share(" ".join([single] * times), own) > COPIED:
        return False
    return sum(w not in asked for w in wa) <= max(1, len(wq) // 10)


# --- terminal contexts -------------------------------------------------------------------


def _cell(*parts: str) -> int:
    return zlib.crc32("\x1f".join(parts).encode("utf-8", "surrogatepass")) % _CELLS


def _features(words: list[str]) -> list[int]:
    """Cells of what stands before an end: the last one to six words, and the last words with the sentence's first."""
    tail = words[-8:]
    first = words[0] if words else ""
    cells = [_cell(str(n), *tail[-n:]) for n in range(1, min(6, len(tail)) + 1)]
    last = tail[-2:]
    cells.append(_cell("f", first, *last))
    cells.append(_cell("a", "and" if "and" in tail[-6:-1] else "", *tail[-3:]))
    cells.append(_cell("l", str(min(len(words), 12))))
    cells.append(_cell("fl", first, str(min(len(words), 25))))
    cells.append(_cell("o", str(bool(words) and words[-1] in OPEN_WORDS)))
    return cells


@dataclass
class TerminalContexts:
    """Whether a text can end where it does: a logistic model of end contexts and the endings that recur without a full stop, see ``recurring_endings``."""

    weights: np.ndarray
    bias: float
    endings: frozenset[str] = frozenset()
    trailing: frozenset[str] = frozenset()

    def score(self, words: list[str]) -> float:
        return self.bias + float(self.weights[_features(words)].sum())


def _last_words(text: str) -> list[str]:
    start = 0
    for match in _SENTENCE.finditer(text):
        start = match.end()
    return _WORD.findall(text[start:].casefold())


def fit_terminal_contexts(answers: list[str], seed: int = 7, passes: int = 4) -> TerminalContexts:
    """Fit on whole sentences of complete answers against the same sentences cut short.

    Labels come from the text itself: a sentence followed by its full stop is complete, its
    prefixes, at a word or inside one, are not.
    """
    rng = np.random.default_rng(seed)
    rows: list[list[int]] = []
    labels: list[int] = []
    for answer in answers:
        text = answer.strip()
        parts = _SENTENCE.split(text)
        if not _CLOSED.search(text) or _ELLIPSIS.search(text):
            parts = parts[:-1]
        for part in parts:
            words = [w.casefold() for w in _WORD.findall(part)]
            if len(words) < 4:
                continue
            rows.append(_features(words))
            labels.append(1)
            for inside in (False, True):
                cut = int(rng.integers(2, len(words)))
                short = words[:cut]
                if inside:
                    whole = words[cut]
                    if len(whole) < 3:
                        continue
                    short = [*short, whole[: int(rng.integers(1, len(whole)))]]
                rows.append(_features(short))
                labels.append(0)
    weights, bias = np.zeros(_CELLS), -1.0
    if rows:
        width = max(map(len, rows))
        cells = np.full((len(rows), width), _CELLS, dtype=np.int64)
        for i, row in enumerate(rows):
            cells[i, : len(row)] = row
        y = np.array(labels, dtype=float)
        w, squares = np.zeros(_CELLS + 1), np.full(_CELLS + 1, 1e-2)
        for _ in range(passes):
            for at in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 256)):
                c = cells[at]
                error = y[at] - 1 / (1 + np.exp(-(bias + w[c].sum(1))))
                step = np.bincount(c.ravel(), np.repeat(error, width), _CELLS + 1)
                touched = np.flatnonzero(step)
                g = step[touched] / len(at) * 8 - 1e-4 * w[touched]
                squares[touched] += g * g
                w[touched] += 0.25 * g / np.sqrt(squares[touched])
                w[_CELLS] = 0.0
        weights = w[:_CELLS]
    return TerminalContexts(weights.astype(np.float32), bias)


def ending_of(text: str) -> tuple[str, str] | None:
    """``ending`` and the last words of a text without a full stop, ``trailing`` and those before its ellipsis, or none."""
    text = text.strip()
    if _ELLIPSIS.search(text):
        return "trailing", " ".join(_last_words(_ELLIPSIS.sub("", text).strip())[-3:])
    if _CLOSED.search(text) or _BROKEN_MARK.search(text):
        return None
    words = _last_words(text)
    return ("ending", " ".join(words[-3:])) if words and words[-1] not in OPEN_WORDS else None


def _endings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for question, answer in zip(batch["question"], batch["answer"], strict=True):
            text = visible_text(answer)
            if (found := ending_of(text)) is not None:
                asked = _fold(_NUMBERING.sub("", visible_text(question))) if isinstance(question, str) and question else ""
                pair = "\x1f".join((" ".join(asked.split()), " ".join(text.split())))
                out.append((*found, hashlib.blake2b(pair.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()))
        yield pd.DataFrame(out, columns=["kind", "ending", "pair"])


def recurring_endings(pairs: DataFrame) -> dict[str, frozenset[str]]:
    """The endings, by kind, that so many of all different pairs have that they are no accident of a cut.

    A pair counts once however often it is exported; one answer to several questions counts for each.
    The share is the lower bound of its confidence interval (Wilson), so few pairs prove no more
    than they do in a large table, and each kind has fewer than 1 / SHARE endings.
    """
    ends = pairs.where("answer is not null and answer <> ''").select("question", "answer").mapInPandas(_endings, "kind string, ending string, pair string").distinct()
    counts = ends.groupBy("kind", "ending").agg(F.count("*").alias("k")).withColumn("n", F.sum("k").over(Window.partitionBy("kind")))
    k, n, square = F.col("k").cast("double"), F.col("n").cast("double"), _Z * _Z
    least = (k + square / 2 - _Z * F.sqrt(k * (n - k) / n + square / 4)) / (n + square)
    found: dict[str, set[str]] = {"ending": set(), "trailing": set()}
    for row in counts.where((k >= SEEN) & (least > SHARE)).collect():
        found[row["kind"]].add(row["ending"])
    return {kind: frozenset(own) for kind, own in found.items()}


def is_truncated(text: str, raw: str, model: TerminalContexts) -> bool:
    """Whether the text breaks off before its end; see ``find_broken_pairs``."""
    text = text.strip()
    if _ELLIPSIS.search(text) and not _BROKEN_MARK.search(text):
        core = _last_words(_ELLIPSIS.sub("", text).strip())
        if " ".join(core[-3:]) in model.trailing:
            return False
        return not core or core[-1] in OPEN_WORDS or model.score(core) < 0
    if _CLOSED.search(text):
        return False
    if _BROKEN_MARK.search(text):
        return True
    if re.search(r"[(\[«“][^()\[\]«»“”]{0,40}$", text):
        return True
    if re.search(r"[)\]»”\"']$", text):
        return False
    words = _last_words(text)
    if len(_WORD.findall(text)) == 1:
        return False
    if not words or words[-1] in OPEN_WORDS:
        return True
    if " ".join(words[-3:]) in model.endings:
        return False
    # so few words are an answer in note form
    return len(_WORD.findall(text)) > 4 and model.score(words) < 0


def defect_of(question: str | None, answer: str | None, model: TerminalContexts) -> str | None:
    """The pair's defect, or none."""
    text = visible_text(answer) if answer else ""
    if is_empty(text):
        return "empty"
    asked = visible_text(question) if question else ""
    if asked and is_copy(asked, text):
        return "copied"
    if is_refusal(text):
        return "refusal"
    if is_truncated(text, answer or "", model):
        return "truncated"
    if asked:
        q, _ = language_of(_WORD.findall(asked.casefold()))
        a, _ = language_of(_WORD.findall(text.casefold()))
        if q and a and q != a:
            return "wrong_language"
    return None


def _judge(shared):
    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            defects = [
                defect_of(q if isinstance(q, str) else None, a if isinstance(a, str) else None, model)
                for q, a in zip(batch["question"], batch["answer"], strict=True)
            ]
            out = batch[["faq_id", "pair_no"]].assign(defect=defects)
            yield out[out["defect"].notna()]

    return judge


def find_broken_pairs(faq: DataFrame, fit_answers: int = FIT_ANSWERS, seed: int = 7) -> DataFrame:
    """(faq_id, pair_no, defect) of every pair whose answer is unusable; pair_no counts from 1.

    The first that holds: ``empty`` (null, blank, bare markup or a filler), ``copied`` (little of
    it is new where the question is the zstandard dictionary), ``refusal`` (at least half of it, by
    the refusal dictionaries of six languages), ``truncated`` (an open
    mark or word at the end, or an end context that the fitted model takes for a cut),
    ``wrong_language`` (complete, its common words of another language than the question's).

    Null and empty pair lists have no pairs; a null pair is empty; a null question leaves only
    the defects of the answer by itself; repeated rows are judged each by themselves; an empty
    table gives no rows. The model is fitted on at most ``fit_answers`` answers; recurring
    endings are counted over all pairs, and all pairs are judged in one pass without a shuffle.
    """
    pairs = faq.select("faq_id", F.posexplode("pairs").alias("at", "pair")).select(
        "faq_id", (F.col("at") + 1).alias("pair_no"), F.col("pair.question").alias("question"), F.col("pair.answer").alias("answer")
    )
    total = max(1, faq.select(F.sum(F.when(F.size("pairs") > 0, F.size("pairs")))).first()[0] or 1)
    # the limit acts only where one faq_id is that of a great part of all rows
    sample = pairs.where("answer is not null").where(sampled(fit_answers / total, seed, "faq_id", "pair_no")).limit(2 * fit_answers)
    answers = [visible_text(r["answer"]) for r in sample.select("answer").collect()]
    model = fit_terminal_contexts(sorted(answers))
    recurring = recurring_endings(pairs)
    shared = faq.sparkSession.sparkContext.broadcast(replace(model, endings=recurring["ending"], trailing=recurring["trailing"]))
    judged = pairs.withColumn("faq_id", sealed("faq_id")).mapInPandas(_judge(shared), "faq_id bigint, pair_no int, defect string")
    return judged.withColumn("faq_id", opened("faq_id"))
