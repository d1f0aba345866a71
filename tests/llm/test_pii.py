import hashlib
import random
import re

from quern.llm.pii import digest, find_pii, sanitise
from quern.llm.queries import op7_pii

KINDS = ["email", "ip", "card", "phone"]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base(text):
    text = text or ""
    out = []
    digits = lambda s: re.sub("[^0-9]", "", s)
    tests = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    for k, (pattern, ok) in enumerate(tests):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if ok(m.group())]
    return sorted(out)


def sha(spans):
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op7_pii(spark, sf).collect()
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        want = base(texts[r.doc_id])
        assert r.base_sha256 == sha(want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]


def test_random_and_odd_texts(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("a1.@+-_ 2(),é😀9%") for _ in range(rng.randint(0, 60)))) for i in range(1500)]
    rows += [(5000, None), (5001, ""), (5002, "1" * 20_000), (5003, "x@y.z " * 2000), (5004, "a@b@c.d a@b.c_d@e.f +1.2.3.4.5.6.7.8.9"), (5004, "1.2.3.4"), (None, "4111 1111 1111 1111")]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, spans string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.base_sha256) for r in digest(find_pii(spark, docs)).collect())
    assert got == sorted((-1 if i is None else i, sha(base(t))) for i, t in rows)
    assert digest(find_pii(spark, docs.limit(0))).count() == 0


def test_disclosing_terms(spark):
    """A rare name that stands near one address in many contexts is found; common words aren't, nor is one copied passage."""
    fill = lambda i: " ".join(f"word{'abcdefghij'[int(c)]}" for c in str(1000 + i * 37))
    rows = [(i, f"{fill(i)} the Zebrowski office at zed@corp.example.com answers {fill(i + 500)}") for i in range(6)]
    rows += [(100 + i, f"the office answers {fill(i)} and {fill(2 * i)}") for i in range(300)]
    rows += [(900 + i, "Quillfeather wrote from quill@solo.example.com today") for i in range(5)]  # copies
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [s.value for s in r.added] for r in find_pii(spark, docs).collect()}
    assert all("zebrowski" in found[i] and "office" not in found[i] and "answers" not in found[i] for i in range(6))
    assert all(not found[i] for i in [*range(100, 400), *range(900, 905)])
    clean = {r.doc_id: r.text for r in sanitise(spark, docs).collect()}
    assert all("Zebrowski" not in clean[i] and "@" not in clean[i] and "office" in clean[i] for i in range(6))
    assert all(clean[i] == t for i, t in rows if 100 <= i < 400)


def test_sanitise_edges(spark):
    names = ["__spans", "__key", "__own_key", "own_key", "text_key", "all_spans", "spans"]
    rows = [(1, None), (2, ""), (3, "é a@b.cd 1.2.3.4 +49 30 1234567 x"), (3, "é a@b.cd 1.2.3.4 +49 30 1234567 x")]
    docs = spark.createDataFrame([(*r, *"abcdefg") for r in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    clean = sanitise(spark, docs)
    assert clean.columns == docs.columns
    got = sorted(((r.doc_id, r.text or "") for r in clean.collect()))
    assert got == [(1, ""), (2, ""), (3, "é [EMAIL] [IP] [PHONE] x"), (3, "é [EMAIL] [IP] [PHONE] x")]
    assert all("".join(r[2:]) == "abcdefg" for r in clean.collect()) and [r.text for r in clean.filter("doc_id = 1").collect()] == [None]
    assert sanitise(spark, docs.limit(0)).count() == 0


def test_lower_case_that_lengthens(spark):
    """Terms are located in the text as it stands, where lower case has more code points."""
    rng = random.Random(12)
    rows = [(i, f"İİİ Zebrowski ẞtraße {pseudo(rng, 30)} zed@corp.example.com {pseudo(rng, 30)}") for i in range(4)]
    rows += [(100 + i, pseudo(rng, 20)) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.added for r in find_pii(spark, docs).collect()}
    for i, text in rows[:4]:
        assert {text[s.start : s.end] for s in found[i]} >= {"İİİ", "Zebrowski", "ẞtraße"}
        assert all(text[s.start : s.end].lower() == s.value for s in found[i])
    assert all("brow" not in r.text and "traße" not in r.text for r in sanitise(spark, docs.filter("doc_id < 100 or doc_id > 0")).collect())


def disclosed(rows):
    """{doc_id: {term: disclosure}} by counting all terms of all documents; no two of them may be near copies."""
    from math import log

    entities, terms = {}, {}
    for i, text in rows:
        spans = base(text)
        bare = list(text)
        for a, _, b in spans:
            bare[a:b] = " " * (b - a)
        terms[i] = [w.lower() for w in re.findall(r"[^\W_]+", "".join(bare))]
        entities[i] = {(k, text[a:b]) for a, k, b in spans}
    n = len(rows)
    with_term = {}
    for i, words in terms.items():
        for w in set(words):
            with_term.setdefault(w, set()).add(i)
    found = {}
    for e in {e for es in entities.values() for e in es}:
        have = {i for i, es in entities.items() if e in es}
        if len(have) < 2 or len(have) == n:
            continue
        tested = {}
        for w in {w for i in have for w in terms[i]}:
            both = have & with_term[w]
            if len(with_term[w]) > 1 and len(with_term[w]) <= len(have) * (n / len(have)) ** (1 - 0.75) * (1 + 1e-9):
                views = []
                for before, after in ((5, 5), (10, 0), (0, 10)):
                    seen = {}
                    for i in both:
                        at = [j for j, x in enumerate(terms[i]) if x == w]
                        whole = [tuple(terms[i][j - before : j + after + 1]) if j >= before and j + after < len(terms[i]) else i for j in at]
                        seen[i] = whole
                    views.append(seen)
                tested[w] = (both, views)
        for w, (both, views) in tested.items():
            k = min([len(both), *(len({x for xs in v.values() for x in xs}) for v in views)])
            expected = len(have) * len(with_term[w]) / n
            if k > 1 and k > expected and k * log(k / expected) - (k - expected) >= log(len(tested) / 0.05):
                score = log(len(both) * n / (len(have) * len(with_term[w]))) / log(n / len(have))
                if score >= 0.75:
                    for i in both:
                        found.setdefault(i, {})[w] = max(score, found.get(i, {}).get(w, 0))
    return found


def test_disclosure_against_brute_force(spark):
    """Every judged term and action of a corpus without copies, by the formula alone."""
    rng = random.Random(21)
    common = pseudo(rng, 40).split()
    rows = []
    for e in range(12):
        names = pseudo(rng, 3).split()
        for d in range(rng.choice([2, 3, 5])):
            words = [rng.choice(common) for _ in range(20)] + pseudo(rng, 25).split()
            words += [w for w in names if rng.random() < 0.8]
            rng.shuffle(words)
            rows.append((len(rows), " ".join([*words[:20], f"user{e}@mail.example.org", *words[20:]])))
        for _ in range(rng.choice([0, 0, 1, 2])):  # the name elsewhere
            rows.append((len(rows), " ".join([names[0], *pseudo(rng, 20).split()])))
    rows += [(1000 + i, " ".join([*pseudo(rng, 12).split(), *rng.sample(common, 10)])) for i in range(300)]
    want = disclosed(rows)
    got = {}
    for r in find_pii(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect():
        for s in r.added:
            got.setdefault(r.doc_id, {})[s.value] = s.action
    assert {i: {w: "remove" if x >= 0.95 else "generalise" for w, x in ws.items()} for i, ws in want.items()} == got and len(got) > 20


def pseudo(rng, n):
    return " ".join("".join(rng.choice("bcdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3)) for _ in range(n))


def test_two_sightings(spark):
    """Two different documents are evidence of a rare term; near copies, a copied passage and a common word aren't."""
    rng = random.Random(7)
    rows = [(i, f"{pseudo(rng, 15)} Zebrowski at zed@corp.example.com {pseudo(rng, 15)} office") for i in range(2)]
    words = pseudo(rng, 60).split()
    for i in range(6):
        own = [*words]
        own[i * 2] = pseudo(rng, 1)
        rows.append((10 + i, " ".join([*own[:25], "Quillfeather quill@solo.example.com", *own[25:]])))
    passage = f"{pseudo(rng, 15)} Thistlewood thi@solo.example.com {pseudo(rng, 15)}"
    rows += [(20 + i, f"{pseudo(rng, 30)} {passage} {pseudo(rng, 30)}") for i in range(4)]
    rows += [(100 + i, f"office {pseudo(rng, 20)}") for i in range(500)]
    found = {r.doc_id: {s.value for s in r.added} for r in find_pii(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("zebrowski" in found[i] and "office" not in found[i] for i in range(2))
    assert all(not found[i] for i in found if i >= 10)


def test_terms_of_whole_documents(spark):
    """A term is judged however far from the entity it stands, and masked at all its places in the entity's documents only."""
    rng = random.Random(8)
    rows = [(i, f"Zebrowski {pseudo(rng, 60)} zed@corp.example.com {pseudo(rng, 60)} İ ZEBROWSKI {pseudo(rng, 3)} Zebrowski") for i in range(3)]
    rows += [(100 + i, f"office {pseudo(rng, 20)}") for i in range(500)]
    rows.append((700, f"Zebrowski {pseudo(rng, 20)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.added for r in find_pii(spark, docs).collect()}
    for i, text in rows[:3]:
        assert [(s.start, s.end) for s in found[i] if s.value == "zebrowski"] == [m.span() for m in re.finditer("(?i)zebrowski", text)]
    clean = {r.doc_id: r.text for r in sanitise(spark, docs).collect()}
    assert all("zebrowski" not in clean[i].lower() for i in range(3)) and clean[700] == dict(rows)[700]


def test_short_terms_and_numbers(spark):
    """Short names, names of two letters in other scripts and numbers are terms, but not what stands in base spans."""
    rng = random.Random(9)
    rows = [(i, f"{pseudo(rng, 20)} Ng zed@corp.example.com {pseudo(rng, 12)} 金 {pseudo(rng, 12)} K4711 {pseudo(rng, 12)} 90210 {pseudo(rng, 5)}") for i in range(3)]
    rows += [(100 + i, f"of {pseudo(rng, 20)}") for i in range(500)]
    found = {r.doc_id: {s.value for s in r.added} for r in find_pii(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i] == {"ng", "金", "k4711", "90210"} for i in range(3))
    assert all(not found[i] for i in range(100, 600))


def test_worn_copies(spark):
    """Near copies of which every seventh word was changed are no independent sightings."""
    rng = random.Random(10)
    words = pseudo(rng, 300).split()
    rows = [(i, "Ng quill@solo.example.com " + " ".join(pseudo(rng, 1) if rng.random() < 0.07 * i else w for w in words[i:])) for i in range(3)]
    rows += [(100 + i, pseudo(rng, 20)) for i in range(300)]
    assert all(not r.added for r in find_pii(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect())
