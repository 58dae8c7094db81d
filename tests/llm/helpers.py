"""Small tables with every odd case, and brute-force versions of the operators."""
from collections import Counter

SHARED = ("the quiet harbour kept its lanterns burning while grey boats came slowly home across a dark and patient sea "
          "and every keeper counted them twice before the bells of morning called the village back to ordinary work again "
          "with bread and salt and rope and the long soft rain that never quite decides to stop falling on the stones")


def texts() -> list[str | None]:
    """Nulls, empty and blank texts, one word, ties, copies, near copies, a shared passage, a very long text."""
    import random

    rnd = random.Random(11)
    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ara", "eno", "ilu", "oto", "umi", "ay")]
    out: list[str | None] = [None, "", " \n\t ", "One", "one", "two words", "\n\n", "42 !! ??", "<|endoftext|> don't 'S"]
    for i in range(40):
        out.append(" ".join(rnd.choices(words, k=rnd.randint(1, 90))))
    base = out[12].split() + out[20].split() + out[25].split()
    for i in range(12):
        copy = list(base)
        copy[rnd.randrange(len(copy))] = f"changed{i}"
        out.append(" ".join(copy))
    out += [" ".join(base)] * 7
    for i in range(6):
        out.append(" ".join(rnd.choices(words, k=30)) + "\n" + SHARED + "\n" + " ".join(rnd.choices(words, k=25)))
    out += ["  A line that is long enough to be counted as a key by itself  \n" + f"own line {i}" for i in range(6)]
    out.append(" ".join(rnd.choices(words, k=30_000)))
    out.append("x" * 50_000)
    out.append("Ça va très bien — naïve façade, 漢字 और हिन्दी")
    return out


def rows() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars) with nulls in every column."""
    out = []
    for i, t in enumerate(texts()):
        out.append((i * 3, t, None if i % 7 == 0 else ("en", "de")[i % 2], None if i % 5 == 0 else f"s{i % 3 if i % 4 else 0}", None))
    return out


# columns that the operators use as names of their own
CLASHING = ["n", "region", "node", "component", "words", "block", "key", "line", "score", "lang_pred", "weight", "tokens",
            "item_id", "digest", "cut_spans", "mix_rate", "held_out", "vector", "share", "rate", "topic_"]


def documents(spark, data=None, clash=True):
    df = spark.createDataFrame(rows() if data is None else data, "doc_id long, text string, lang string, source string, n_chars long")
    if clash:
        df = df.selectExpr("*", *[f"CAST(NULL AS STRING) AS `{c}`" for c in CLASHING])
    return df.repartition(3)


def empty_documents(spark):
    return documents(spark, []).limit(0)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words_of(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def shingle_set(text, k):
    w = words_of(text)
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard(data, k, num, den):
    """{doc_id: (set size, component)}."""
    sets = {d: shingle_set(t, k) for d, t in data}
    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    links = []
    for d, s in sets.items():
        for o, m in Counter(o for x in s for o in holders[x] if o < d).items():
            if den * m >= num * (len(s) + len(sets[o]) - m):
                links.append((d, o))
    comp = components(sets, links)
    return {d: (len(s), comp[d]) for d, s in sets.items()}
