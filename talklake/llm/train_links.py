"""Fits the weights of reply links: python -m talklake.llm.train_links FOLDER

Stated replies tell which earlier message of a channel is the parent; messages that state none are starts. Of at most
SAMPLE messages, every earlier message within reach is a pair, true if it is the stated parent. A logistic regression over
the pairs gives the weights in talks.py. A tenth of the messages, by a hash of their id, is held out for the figures.
"""

from __future__ import annotations

import sys

import numpy as np

from .talks import NAMES, REACH_US, features, words_of

SAMPLE = 200_000
#: Where the sample says nothing, mentions and shared words speak for a link; strength of this prior in pairs.
PRIOR, STRENGTH = {"mention": 2.0, "words": 1.0}, 1.0


def pairs(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    rows = con.execute(
        rf"""select channel, us, id, author, parent, content from (select trim(id) as id, trim(channel_id) as channel, nullif(trim(author_id), '') as author, epoch_us(try_cast(created_at as timestamptz)) as us,
        nullif(nullif(regexp_replace(reply_to_message_id, '^\s+|\s+$', '', 'g'), ''), '0') as parent, coalesce(content, '') as content, row_number() over (partition by trim(id) order by try_cast(updated_at as timestamptz) desc) as n from '{folder}/messages.parquet')
        where n = 1 and channel is not null and us is not null order by channel, us, id limit {SAMPLE}"""
    ).fetchall()
    x, y, group, held = [], [], [], []
    first = 0
    kept: list[tuple] = []
    before = None
    for i, (channel, us, mid, author, parent, content) in enumerate(rows):
        if channel != before:
            before, kept, first = channel, [], 0
        mentions, words = words_of(content)
        while first < len(kept) and us - kept[first][0] > REACH_US:
            first += 1
        for back, (at, other, by, theirs) in enumerate(reversed(kept[first:]), 1):
            x.append(features(us - at, back, author, by, mentions, words, theirs))
            y.append(other == parent)
            group.append(i)
            held.append(hash_of(mid) % 10 == 0)
        kept.append((us, mid, author, words))
    truth = {i: r[4] for i, r in enumerate(rows)}
    return np.array(x), np.array(y, float), np.array(group), np.array(held), truth, sum(r[4] is not None and hash_of(r[2]) % 10 == 0 for r in rows)


def hash_of(text: str) -> int:
    from zlib import crc32

    return crc32(text.encode())


def main(folder: str) -> None:
    x, y, group, held, _, replies = pairs(folder)
    prior = np.array([PRIOR.get(n, 0.0) for n in NAMES])
    w = prior.copy()
    a, b = x[~held], y[~held]
    for _ in range(40):
        p = 1 / (1 + np.exp(-a @ w))
        h = (a * (p * (1 - p))[:, None]).T @ a + STRENGTH * np.eye(len(w))
        w -= np.linalg.solve(h, a.T @ (p - b) + STRENGTH * (w - prior))
    print(dict(zip(NAMES, w.round(3))))
    s = x[held] @ w
    g, yy = group[held], y[held]
    best = {}
    for k in range(len(s)):
        if g[k] not in best or s[k] > best[g[k]][0]:
            best[g[k]] = (s[k], yy[k])
    score = np.array([v[0] for v in best.values()])
    right = np.array([v[1] for v in best.values()])
    print(len(best), "held-out messages with candidates;", replies, "of the held-out messages are replies")
    for t in (0.2, 0.3, 0.4, 0.5, 0.6, 0.7):
        on = 1 / (1 + np.exp(-score)) >= t
        print(f"threshold {t}: recall {right[on].sum() / replies:.3f}, precision {right[on].mean():.3f}")


if __name__ == "__main__":
    main(sys.argv[1])
