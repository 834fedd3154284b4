"""Small tables with the awkward cases, and plain versions of the operators to hold results against."""
import re
from collections import defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, rank int, score string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def awkward(spark, extra=()):
    """Null and empty texts, null keys, repeated rows, equal texts, a long text, columns with names that operators use."""
    long_text = " ".join(f"w{i % 977} and{i % 13}" for i in range(20_000))
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n", None, None), (4, "One two THREE", "en", "b"), (5, "one  two\nthree", "en", None),
            (6, "One two THREE", "de", "b"), (6, "One two THREE", "de", "b"), (7, long_text, "en", "a"), (8, long_text + " end", None, "c"),
            (9, "Größe ñ 漢字 \U0001F600 $$$ ###", "de", "c"), (None, "no id here at all", "en", "a"), (10, "x" * 5000, "en", "é"), *extra]
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "size", 1, "score") for i, t, lang, s in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return WORDS.findall(text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def groups(rows, k, percent):
    """{doc_id: (size, least doc_id of the group)} by comparing every pair."""
    sets = {}
    for i, t in rows:
        w = words(lowered(t))
        sets[i] = {" ".join(w)} if 0 < len(w) < k else {" ".join(w[j:j + k]) for j in range(len(w) - k + 1)}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in ids}


def copies(rows):
    """{doc_id: (keep_id, size)} of rows with distinct ids."""
    by = defaultdict(list)
    for i, t in rows:
        by[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    return {i: (min(v)[1], len(v)) for v in by.values() for _, i in v}
