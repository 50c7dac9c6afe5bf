"""Explanations that belong to another question of their document.

A document's questions come out of one text cell, so they are gathered into one row and compared there: pairs of questions that share a
token are counted in a small matrix, block by block, and never become rows of a shuffle.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

CELLS = 2_000_000


def _pairs(q, tok, n_tok):
    """Distinct (question, token) pairs as sorted codes."""
    return np.unique(q * n_tok + tok)


def _counts(e, tok, start, length, held, n):
    """Matrix of common tokens: the rows ``e`` (from 0) of explanations with ``tok`` against all ``n`` questions that hold it."""
    many = length[tok]
    at = np.repeat(start[tok] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    rows = int(e[-1]) + 1
    return np.bincount(np.repeat(e, many) * n + held[at], minlength=rows * n).reshape(rows, n)


def document_actions(seq, q, tok, xq, xtok, exp_len, low, high, least, cap, letters, known, long):
    """(moves, removed) of one document: moves are (seq, to, score), removed are rows of ``seq``.

    ``q`` and ``tok`` give the row and the token of every token of a question, ``xq`` and ``xtok`` those of the explanations.
    """
    names, at = np.unique(seq, return_inverse=True)
    n, n_tok = len(names), int(max(tok.max(initial=0), xtok.max(initial=0))) + 1
    t = _pairs(at[q], tok, n_tok)
    df = np.bincount(t % n_tok, minlength=n_tok)
    t = t[df[t % n_tok] <= max(3.0, len(seq) * 0.08)]
    size = np.bincount(t // n_tok, minlength=n)
    every = _pairs(at[xq], xtok, n_tok)
    x = _pairs(at[xq[exp_len[xq] >= letters]], xtok[exp_len[xq] >= letters], n_tok)
    x = x[size[x // n_tok] >= least]
    shared = np.bincount(every[np.isin(every, t, assume_unique=True)] // n_tok, minlength=n) > 0
    t = t[size[t // n_tok] >= least]
    per = np.where(size >= least, np.minimum(size, cap), 1).astype(float)
    owner = np.zeros(n, bool)
    owner[x // n_tok] = True
    own = np.bincount(x[np.isin(x, t, assume_unique=True)] // n_tok, minlength=n) / per
    flagged = np.flatnonzero(owner & (own < low))
    order = np.argsort(t % n_tok, kind="stable")
    held = t[order] // n_tok
    length = np.bincount(t % n_tok, minlength=n_tok)
    start = np.cumsum(length) - length
    best = {}
    step = max(1, CELLS // n)
    for a in range(0, len(flagged), step):
        some = flagged[a:a + step]
        lo, hi = np.searchsorted(x, [some[0] * n_tok, (some[-1] + 1) * n_tok])
        mine = x[lo:hi][np.isin(x[lo:hi] // n_tok, some)]
        score = _counts(np.searchsorted(some, mine // n_tok), mine % n_tok, start, length, held, n) / per
        score[np.arange(len(some)), some] = 0
        to = n - 1 - np.argmax(score[:, ::-1], axis=1)
        top = score[np.arange(len(some)), to]
        ok = (top >= high) & (top >= own[some] * 3 + 0.2)
        ok &= ~(owner[to] & (own[to] >= top / 2) & (own[to] >= low))
        for e, j, s in zip(some[ok].tolist(), to[ok].tolist(), top[ok].tolist()):
            best[j] = max(best.get(j, (-1.0, -1)), (s, e))
    gone = np.zeros(n, bool)
    gone[[e for _, e in best.values()]] = True
    lost = (exp_len >= max(letters, long)) & (size >= max(least, known))[at] & ~shared[at] & ~gone[at]
    return [(names[e], names[j], s) for j, (s, e) in best.items()], seq[lost]


def _flat(lists):
    """(codes' owner, strings) of a list column: the list that every item stands in, and the items."""
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten()


def explanation_actions(questions, low=0.15, high=0.4, least=6, cap=15, letters=40, known=8, long=60):
    """(doc, seq, action, to, score): explanations that are ``moved`` to another question and those that are ``removed``.

    ``questions(doc, seq, sig, exp_sig, exp_len)``: token arrays of stem with options and of the explanation.
    """
    kind = {c: questions.schema[c].dataType.simpleString() for c in ("doc", "seq")}
    tokens = lambda c: F.array_compact(F.coalesce(c, F.array().cast("array<string>"))).alias(c)
    rows = (questions.where("doc IS NOT NULL AND seq IS NOT NULL")
            .select("doc", F.struct("seq", tokens("sig"), tokens("exp_sig"), F.coalesce("exp_len", F.lit(0)).cast("int").alias("exp_len")).alias("q"))
            .groupBy("doc").agg(F.collect_list("q").alias("q")).select("doc", "q.seq", "q.sig", "q.exp_sig", "q.exp_len"))

    def fold(batches):
        for b in batches:
            out = []
            for i in range(b.num_rows):
                doc, seq, sig, exp, exp_len = (b.column(c)[i] for c in range(5))
                q, words = _flat(sig.values)
                xq, said = _flat(exp.values)
                codes = pa.concat_arrays([words, said]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                moves, removed = document_actions(seq.values.to_numpy(zero_copy_only=False), q, codes[:len(q)], xq, codes[len(q):],
                                                  exp_len.values.to_numpy(zero_copy_only=False), low, high, least, cap, letters, known, long)
                doc = doc.as_py()
                out += [(doc, e, "moved", j, s) for e, j, s in moves] + [(doc, e, "removed", None, None) for e in removed]
            cols = list(zip(*out)) or [()] * 5
            types = [b.schema.field(0).type, b.schema.field(1).type.value_type, pa.string(), b.schema.field(1).type.value_type, pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=["doc", "seq", "action", "to", "score"])
    return rows.mapInArrow(fold, f"doc {kind['doc']}, seq {kind['seq']}, action string, to {kind['seq']}, score double")
