"""Answers and whatever else a language model writes. The model is the caller's: a function of a prompt that gives a reply.

Prompts are built by expressions; models run where the rows are, so a failing reply costs its own row alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamfield.operators.semantic import cosine, split_sentences
from loamfield.sources.parsers import reply_json

Model = Callable[[str], str]
Search = Callable[[str], list[tuple[str, float]]]
#: Stands between the sources of a prompt.
BAR = "\n\n---\n\n"
NOT_FOUND = "not found"


def prompt(hits: DataFrame) -> DataFrame:
    """``query, context``: ``[Source i]`` and the text of each hit (query, rank, text and, if there, compressed, which is
    preferred), in the order of ranks."""
    body = F.coalesce("compressed", "text") if "compressed" in hits.columns else F.col("text")
    x = F.sort_array(F.collect_list(F.struct("rank", body.alias("t"))))  # one query's hits
    told = F.transform(x, lambda s, i: F.concat(F.lit("[Source "), (i + 1).cast("string"), F.lit("]\n"), s["t"]))
    return hits.groupBy("query").agg(F.array_join(told, BAR).alias("context"))


def replies(prompts: DataFrame, model: Model, column: str = "prompt") -> DataFrame:
    """``prompts`` with ``reply``; null where the model failed."""

    def run(batches):
        for b in batches:
            out = []
            for p in b[column]:
                try:
                    out.append(model(p) if p is not None else None)
                except Exception:  # noqa: BLE001
                    out.append(None)
            yield b.assign(reply=pd.Series(out, dtype=object, index=b.index))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)
    return prompts.mapInPandas(run, f"{fields}, reply string")


def stream(sources: list[str], deltas):
    """The sources first, then what the model says, as it says it."""
    yield "sources", list(sources)
    for d in deltas:
        yield "delta", d


# ---- ways to answer ------------------------------------------------------------------------------------------------
def map_reduce(question: str, texts: list[str], model: Model) -> str:
    """An answer from each text, those that found nothing left out, then one from all of them."""
    found = [a for t in texts if (a := model(f"{question}\n\n{t}")) and NOT_FOUND not in a.lower()]
    return model(f"{question}\n\n{BAR.join(found)}") if found else NOT_FOUND


def refine(question: str, texts: list[str], model: Model) -> str:
    """The first text is answered from, each further one refines the answer."""
    answer = ""
    for t in texts:
        answer = model(f"{question}\n\n{t}" if not answer else f"{question}\n\n{answer}\n\n{t}")
    return answer


def active(question: str, model: Model, confidence: Callable[[str], float], search: Search, least: float = 0.6, rounds: int = 3, k: int = 10) -> tuple[str, list[tuple[str, float]]]:
    """An answer by sentences: one of little confidence is searched for and written again; the best score of each text stays."""
    held: dict[str, float] = {t: s for t, s in search(question)}
    answer = model(f"{question}\n\n{BAR.join(held)}")
    for _ in range(rounds):
        weak = next((s for s in split_sentences(answer) if confidence(s) < least), None)
        if weak is None:
            break
        for t, s in search(weak):
            held[t] = max(s, held.get(t, s))
        answer = model(f"{question}\n\n{BAR.join(sorted(held, key=lambda t: (-held[t], t))[:k])}")
    return answer, sorted(held.items(), key=lambda x: (-x[1], x[0]))


def engine(name: str) -> Callable:
    """The way to answer by name."""
    ways = {"map_reduce": map_reduce, "refine": refine, "active": active, "chat": lambda q, texts, model: model(f"{q}\n\n{BAR.join(texts)}")}
    if name not in ways:
        raise ValueError(f"no engine named {name}")
    return ways[name]


def confidence(answer: str, texts: list[str], model: Model, most: int = 1500) -> float:
    """What the model says that an answer is worth beside the first three texts, from 0 to 1; 1 if it doesn't say."""
    m = re.search(r"-?\d+(?:\.\d+)?", model(f"{answer}\n\n{BAR.join(texts[:3])[:most]}") or "")
    return min(1.0, max(0.0, float(m[0]))) if m else 1.0


def research(question: str, search: Search, model: Model, rounds: int = 3, more: int = 3) -> list[tuple[str, float]]:
    """All texts found in up to ``rounds`` rounds, best first: after each the model says whether they do, and what to ask next."""
    held, todo = {}, [question]
    for _ in range(rounds):
        for q in todo:
            for t, s in search(q):
                held[t] = max(s, held.get(t, s))
        said = reply_json(model(f"{question}\n\n{BAR.join(held)}")) or {}
        todo = [q for q in said.get("queries", []) if isinstance(q, str)][:more] if isinstance(said, dict) and not said.get("sufficient", True) else []
        if not todo:
            break
    return sorted(held.items(), key=lambda x: (-x[1], x[0]))


# ---- before a search -----------------------------------------------------------------------------------------------
def hypothetical(question: str, model: Model, embed: Callable[[list[str]], list[list[float]]], n: int = 3) -> list[float]:
    """The mean vector, at length 1, of n answers that the model makes up; blank and failed ones don't count. One alone is
    taken as it is; without any the question's vector is."""
    made = []
    for _ in range(n):
        try:
            t = model(question)
        except Exception:  # noqa: BLE001
            continue
        if t and t.strip():
            made.append(t)
    if not made:
        return list(embed([question])[0])
    v = np.asarray(embed(made), np.float64)
    mean = v.mean(axis=0)
    norm = float(np.linalg.norm(mean))
    return (mean / norm if norm and len(made) > 1 else v[0]).tolist()


def self_query(question: str, model: Model, allowed: list[str]) -> tuple[str, dict[str, str]]:
    """(what to search for, filter on allowed keys) as the model reads a question; the question itself if it can't."""
    said = reply_json(model(question))
    if not isinstance(said, dict) or not str(said.get("query") or "").strip():
        return question, {}
    got = said.get("filter") if isinstance(said.get("filter"), dict) else {}
    return str(said["query"]), {k: str(v) for k, v in got.items() if k in allowed and v is not None}


def rerank(hits: DataFrame, score: Callable[[list[str], list[str]], list[float]], k: int = 5, logits: bool = True, batch: int = 1000) -> DataFrame:
    """``hits`` (query, question, doc, text, score) in the order of a pair model, the k best, with ``relevance``; their own
    scores stay."""

    def run(batches):
        for b in batches:
            s: list[float] = []
            for i in range(0, len(b), batch):
                s += list(score(b["question"].iloc[i : i + batch].tolist(), b["text"].iloc[i : i + batch].tolist()))
            x = np.asarray(s, np.float64)
            yield b.assign(relevance=1 / (1 + np.exp(-x)) if logits else x)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema)
    w = Window.partitionBy("query").orderBy(F.desc("relevance"), F.desc("score"), "doc")
    return hits.mapInPandas(run, f"{fields}, relevance double").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# ---- what models extract -------------------------------------------------------------------------------------------
def metadata(reply: str | None, have: dict[str, str], allowed: list[str] | None = None) -> dict[str, str]:
    """A chunk's metadata with what a model found: flat texts of allowed keys, none of which replaces what is there."""
    said = reply_json(reply)
    got = {k: v for k, v in said.items() if isinstance(v, str) and (allowed is None or k in allowed)} if isinstance(said, dict) else {}
    return got | have


def propositions(passage: str, model: Model, most: int = 50) -> list[str]:
    """The claims of a passage, or the passage itself if the model gives none."""
    try:
        said = reply_json(model(passage))
    except Exception:  # noqa: BLE001
        said = None
    got = [x.strip() for x in said if isinstance(x, str) and x.strip()][:most] if isinstance(said, list) else []
    return got or [passage]


def resume(text: str, model: Model) -> list[tuple[str, str]]:
    """(section, text) of a résumé as the model reads it: contact, work, education, skills; the whole text if it can't."""
    said = reply_json(model(text))
    out = []
    for k in ("contact", "work", "education", "skills"):
        v = said.get(k) if isinstance(said, dict) else None
        for x in v if isinstance(v, list) and k in ("work", "education") else [v]:
            if x:
                out.append((k, ", ".join(f"{a}: {b}" for a, b in x.items()) if isinstance(x, dict) else ", ".join(map(str, x)) if isinstance(x, list) else str(x)))
    return out or [("text", text)]


def mind_map(reply: str | None, most: int = 1000) -> tuple[list[str], list[tuple[str, str]]]:
    """(topics, (topic, subtopic) pairs) of a tree {topic, subtopics: [...]} in a model's reply, breadth first."""
    said = reply_json(reply)
    names, edges, todo = [], [], [(None, said)]
    while todo and len(names) < most:
        up, x = todo.pop(0)
        if isinstance(x, dict) and str(x.get("topic") or "").strip():
            name = str(x["topic"]).strip()
            if name not in names:
                names.append(name)
            if up is not None:
                edges.append((up, name))
            todo += [(name, y) for y in x.get("subtopics") or []]
    return names, edges


def redact_by_model(text: str, model: Model, fallback: Callable[[str], str]) -> str:
    """What the model leaves of a text, or what the patterns do if it fails or says nothing."""
    try:
        said = model(text)
    except Exception:  # noqa: BLE001
        said = None
    return said if said and said.strip() else fallback(text)


def summary(turns: list[str], model: Model, before: str = "") -> str:
    """A summary of turns that leave a conversation's window, with the one before them."""
    return model("\n".join([x for x in (before, *turns) if x])) if turns else before


# ---- judging -------------------------------------------------------------------------------------------------------
def verdict(reply: Column) -> Column:
    """true or false for yes or no, whatever marks stand around it; null for anything else."""
    bare = F.lower(F.regexp_replace(reply, r'^[.!*",:\s]+|[.!*",:\s]+$', ""))
    return F.when(bare == "yes", True).when(bare == "no", False)


def statements(reply: Column) -> Column:
    """The texts of a JSON array of texts; null for any other reply."""
    t = F.trim(reply)
    return F.when(F.rlike(t, F.lit(r'(?s)^\[\s*(?:"(?:[^"\\]|\\.)*"\s*(?:,\s*"(?:[^"\\]|\\.)*"\s*)*)?\]$')), F.from_json(t, "array<string>"))


def relevance(question: list[float], made: list[list[float]], evasive: bool) -> float:
    """The mean likeness of a question to those that an answer would answer, from 0 to 1; 0 for an evasive answer."""
    return 0.0 if evasive or not made else min(1.0, max(0.0, float(np.mean([cosine(question, x) for x in made]))))


def judged(reply: str | None, criteria: list[str]) -> dict[str, float] | None:
    """A score from 0 to 1 for each criterion of a judge's JSON; null if one is missing or no number."""
    said = reply_json(reply)
    if not isinstance(said, dict) or not all(isinstance(said.get(c), int | float) and not isinstance(said.get(c), bool) for c in criteria):
        return None
    return {c: min(1.0, max(0.0, float(said[c]))) for c in criteria}


def dataset(chunks: DataFrame, model: Model, n: int, seed: int = 42) -> DataFrame:
    """``chunk, question, answer, skipped`` of n sampled chunks (chunk, text): skipped tells why one gives no question."""
    drawn = chunks.orderBy(F.md5(F.concat(F.col("chunk").cast("string"), F.lit(f":{seed}")).cast("binary")), "chunk").limit(n)

    def run(batches):
        for b in batches:
            rows = []
            for c, r in zip(b["chunk"], b["reply"], strict=True):
                said = reply_json(r)
                q, a = (str(said.get(k) or "").strip() for k in ("question", "answer")) if isinstance(said, dict) else ("", "")
                rows.append((c, q or None, a or None, "no reply" if r is None else "no JSON" if said is None else "no question" if not q else "no answer" if not a else None))
            yield pd.DataFrame(rows, columns=["chunk", "question", "answer", "skipped"], dtype=object).astype({"chunk": "int64"})

    return replies(drawn, model, "text").mapInPandas(run, "chunk long, question string, answer string, skipped string")
