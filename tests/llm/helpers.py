"""Small tables with the troubles of real ones: nulls, empty and blank texts, repeats, late versions, extra columns."""

import datetime as dt
import random

WORDS = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor invidunt ut labore et dolore magna aliquyam erat voluptua at vero eos accusam justo duo dolores ea rebum stet clita kasd gubergren".split()
PAGE = "page_id bigint, title string, content string, lang string, crawled_at timestamp, loaded_at timestamp, rep string, terms string, copy int, _rn int, k string"


def time(i):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (f"{rng.randrange(40)}" if rng.random() < 0.4 else "") + ("." if rng.random() < 0.1 else "") for _ in range(n))


def page_rows(seed=1, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = prose(rng, rng.randrange(30, 160))
        rows.append([i, f"Title {i}", text, "en", time(i), time(i)])
    for i in range(n, n + 25):
        base = rows[rng.randrange(n)][2].split(" ")
        for _ in range(rng.randrange(0, 8)):
            base[rng.randrange(len(base))] = rng.choice(WORDS)
        rows.append([i, f"Copy {i}", " ".join(base), None, time(i), time(i)])
    for i in (5, 6):
        rows.append([200 + i, f"Same {i}", rows[5][2], "en", time(i), time(i)])
    rows += [[300, None, None, None, time(1), time(1)], [301, "", "", "en", time(1), time(1)], [302, " ", " \n\t ", "en", time(1), time(1)], [None, "x", prose(rng, 60), "en", time(1), time(1)]]
    # an older version, loaded later; and an exact repeat
    rows.append([3, "Old", "entirely old words " * 40, "en", time(-5), time(999)])
    rows.append(list(rows[4]))
    return [tuple(r) + ("r", "t", 1, 1, "k") for r in rows]


def pages(spark, rows=None):
    return spark.createDataFrame(page_rows() if rows is None else rows, PAGE).repartition(3)


def counted(rows):
    best = {}
    for r in rows:
        if r[0] is not None and (r[0] not in best or r[4] > best[r[0]][4]):
            best[r[0]] = r
    return best


def squeeze(text):
    import re

    return re.sub("[ \t\r\n]+", " ", text.lower())
