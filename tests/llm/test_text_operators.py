"""Operators on texts against plain brute-force versions, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithos.llm import decontamination, licenses, near_dup, pieces, quality, secret_scan, sharding, toxicity
from lithos.llm import queries as llm_queries
from lithos.llm.queries import piece_model

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, node string, size int, words string"


def odd(spark, texts):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in texts], ODD)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.collect()}


LONG = "alpha beta gamma delta " * 30_000
EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "x"), (5, LONG), (6, "same words here again and again"), (7, "same words here again and again"), (7, "same words here again and again"), (None, "lone text")]


def test_a_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    from types import SimpleNamespace as Fake

    from lithos.llm import common

    context = Fake(getConf=lambda: {}, master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Fake(sparkContext=context, conf={}))


# Licences


def test_notices_found_anywhere(spark):
    mit = licenses.TEMPLATES["MIT"]
    rows = [(1, f"Some prose first. {mit} And prose after."), (2, "Licensed under the Apache License, Version 2.0."), (3, "no notice in here"), (4, None), (5, ""), (6, "x " + mit.replace("Software", "Program", 2)), (1, f"Some prose first. {mit} And prose after.")]
    got = {(r["doc_id"], r["license"]) for r in licenses.notices(odd(spark, rows)).collect()}
    assert got == {(1, "MIT"), (2, "Apache-2.0-line"), (6, "MIT")}
    assert licenses.notices(odd(spark, rows)).count() == 3
    assert licenses.notices(odd(spark, rows).limit(0)).count() == 0


def test_dice_by_hand(spark):
    text = "Released under the MIT licence terms"
    a, b = (Counter(zip(w, w[1:])) for w in (re.findall("[a-z0-9]+", t.lower()) for t in (text, licenses.TEMPLATES["MIT-line"])))
    common = sum((a & b).values())
    got = licenses.notices(odd(spark, [(1, text)]), threshold=0.5).first()
    assert got["license"] == "MIT-line" and got["dice"] == pytest.approx(2 * common / (common + sum(b.values())))


def test_repeated_notices_and_notices_in_prose(spark):
    prose = "The rest of the story is told in the first part of the book, and to the best of our knowledge any person in the city knew the name of the author and the terms of use. In the case of the river it was the work of the rain. "
    rows, want = [], set()
    for k, (name, text) in enumerate(licenses.TEMPLATES.items()):
        n = len(re.findall("[a-z0-9]+", text.lower()))
        if n < 30:
            continue
        rows += [(10 * k, f"{text} and here once more {text}"), (10 * k + 1, f"{prose} {text} {prose}"), (10 * k + 2, f"{text} {text} {text}")]
        p = len(re.findall("[a-z0-9]+", prose.lower()))
        want |= {(10 * k, name, 0, n), (10 * k, name, n + 4, 2 * n + 4), (10 * k + 1, name, p, p + n)} | {(10 * k + 2, name, i * n, (i + 1) * n) for i in range(3)}
    rows.append((None, rows[0][1]))
    want |= {(None, *w[1:]) for w in want if w[0] == rows[0][0]}
    got = [(r["doc_id"], r["license"], r["start_word"], r["end_word"], r["dice"]) for r in licenses.notices(odd(spark, rows)).collect()]
    assert {g[:4] for g in got} == want and len(got) == len(want) and all(g[4] >= 0.98 for g in got)


def dice_of(words, template):
    a, b = (Counter(zip(w, w[1:])) for w in (words, template))
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))


def test_no_notice_is_lost(spark):
    """By brute force over all windows: each that reaches the threshold meets a notice told, and each
    told has the coefficient of its words."""
    words = lambda t: re.findall("[a-z0-9]+", t.lower())
    line = licenses.TEMPLATES
    texts = {
        1: "Released under the MIT License. Released under the MIT License.",
        2: "Licensed under CC BY 4.0.\nLicensed under CC BY-SA 4.0.\nLicensed under CC BY-NC 4.0.",
        3: f"{line['GPL-2.0-line']}\n{line['GPL-3.0-line']}",
        4: f"{line['MIT-line']} {line['Apache-2.0-line']} {line['BSL-1.0']}",
        5: f"{line['BSD-3-Clause']} {line['BSD-2-Clause']}",
    }
    dice, names = random.Random(14), [k for k, t in line.items() if len(words(t)) < 60]
    for i in range(6, 26):
        parts = []
        for _ in range(dice.randint(1, 4)):
            w = words(line[dice.choice(names)])
            for _ in range(dice.randint(0, max(1, len(w) // 12))):
                w[dice.randrange(len(w))] = dice.choice(["license", "the", "odd", "of"])
            parts += w + ["some", "prose", "under", "the"][: dice.randint(0, 4)]
        texts[i] = " ".join(parts)
    told = {}
    for r in licenses.notices(odd(spark, list(texts.items()))).collect():
        w = words(texts[r["doc_id"]])[r["start_word"] : r["end_word"]]
        assert r["dice"] == pytest.approx(dice_of(w, words(line[r["license"]]))) and r["dice"] >= 0.8
        told.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"], r["license"]))
    for i, text in texts.items():
        w, spans = words(text), sorted(told.get(i, []))
        assert all(a[1] - 1 <= b[0] for a, b in zip(spans, spans[1:]))  # they share no bigram
        for name, template in line.items():
            t = words(template)
            for a in range(len(w)):
                for z in range(a + max(2, int(0.6 * len(t))), min(len(w), a + int(1.6 * len(t)) + 2) + 1):
                    if not any(a < end - 1 and start < z - 1 for start, end, _ in spans):
                        assert dice_of(w[a:z], t) < 0.8, (i, name, a, z)
    kinds = {i: [n for _, _, n in sorted(told[i])] for i in range(1, 6)}
    assert kinds == {1: ["MIT-line", "MIT-line"], 2: ["CC-BY-4.0-line", "CC-BY-SA-4.0-line", "CC-BY-NC-4.0-line"], 3: ["GPL-2.0-line", "GPL-3.0-line"], 4: ["MIT-line", "Apache-2.0-line", "BSL-1.0"], 5: ["BSD-3-Clause", "BSD-2-Clause"]}


# Near duplicates


def exact_classes(texts, threshold=0.8):
    words = lambda t: re.findall(r"\w+", t.lower())

    def bag(t):
        w = words(t)
        return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()

    bags, parent = {i: bag(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            low, high = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if texts[i] == texts[j] or low and low >= threshold * high:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


def test_near_dup_equals_brute_force(spark, documents, texts):
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(documents).collect()}
    assert got == exact_classes(texts)


def test_near_dup_edges(spark):
    rows = near_dup.classes(odd(spark, EDGES)).collect()
    got = [(r["doc_id"], r["class_id"]) for r in rows]
    assert len(got) == len(EDGES)
    assert sorted(got, key=repr) == sorted([(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 6), (7, 6), (None, None)], key=repr)
    assert near_dup.classes(odd(spark, EDGES).limit(0)).count() == 0


def test_links_across_blocks_of_a_bucket_equal_all_pairs(spark, monkeypatch):
    """A star (copies are near their base only) and a chain in one bucket, cut into small blocks."""
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    base = [f"w{i}" for i in range(60)]
    star = [base] + [base[: 5 * k + 7] + [f"x{k}"] + base[5 * k + 8 :] for k in range(8)]
    chain = [[f"c{i}" for i in range(6 * k, 6 * k + 60)] for k in range(5)]
    rows = [(bytes([i]), " ".join(words)) for i, words in enumerate(star + chain)]
    cells = {n: np.sort(near_dup.regions(near_dup.Shingler().shingles(t))) for n, t in rows}
    true = {(u, v) for u in cells for v in cells if u < v and near_dup.similarity(cells[u], cells[v]) >= 0.8}
    shared = spark.createDataFrame([(1, n) for n, _ in rows], "key long, node binary")
    labels = spark.createDataFrame([(n, n) for n, _ in rows], "node binary, label binary")
    texts = spark.createDataFrame(rows, "node binary, text string")
    got = {(bytes(r["u"]), bytes(r["v"])) for r in near_dup.further_links(shared, labels, texts, 0.8).collect()}
    assert got == true and len(true) == 12


def test_dart_signatures_estimate_weighted_jaccard():
    import numpy as np

    dice = random.Random(3)
    for overlap in (0.3, 0.8, 0.95):
        agree = total = 0
        for _ in range(12):
            common = [dice.getrandbits(64) for _ in range(int(400 * overlap))]
            extra = lambda: [dice.getrandbits(64) for _ in range(400 - len(common))]  # noqa: E731, B023
            a, b = (np.sort(near_dup.regions(np.array(common + common[:50] + extra(), np.uint64))) for _ in range(2))
            agree += int((near_dup.signature(a) == near_dup.signature(b)).sum())
            total += near_dup.K
            true = near_dup.similarity(a, b)
        assert abs(agree / total - true) < 0.06


def test_components(spark):
    links = [(b"a", b"b"), (b"b", b"c"), (b"c", b"d"), (b"d", b"e"), (b"x", b"y"), (b"m", b"z"), (b"m", b"n"), (b"n", b"z")] + [(b"k%03d" % i, b"k%03d" % (i + 1)) for i in range(100)]
    got = {bytes(r["node"]): bytes(r["label"]) for r in near_dup.components(spark.createDataFrame(links, "u binary, v binary")).collect()}
    groups = {}
    for n, label in got.items():
        groups.setdefault(label, set()).add(n)
    assert sorted(len(g) for g in groups.values()) == [2, 3, 5, 101]


# Toxicity


def test_grammar_reads_clauses():
    reader = toxicity.Reader([])
    assert reader.patterns("You are an idiot. Fine day.") == ["insult+target"]
    assert reader.patterns("he said you are pathetic") == ["insult+target-reported"]
    assert reader.patterns("this is not stupid") == ["insult-negated"]
    assert reader.patterns("I will hurt you") == ["threat+target"]
    assert reader.patterns("hurt feelings; nothing else") == []
    model = toxicity.Model()
    score = lambda t: toxicity.score_of(reader.patterns(t), model)
    assert score("you idiot") > score("an idiot") > score("he said idiot") > score("fine") == score("")


def plain_score(text, model):
    """The grammar said in loops: of each clause the head with the fewest marks, the first of such."""
    lists = {"T": toxicity.TARGETS, "N": toxicity.NEGATIONS, "R": toxicity.REPORTS, "W": toxicity.INTENTS, "V": toxicity.THREATS, "I": toxicity.INSULTS}
    known = {}
    for mark, words in lists.items():
        known |= dict.fromkeys(words.split(), mark)
    clean = 1 - model.base
    for clause in re.split(r"[.!?;\n]", text.lower()):
        words = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)*", clause)
        marks = [known.get(w) or ("N" if w in model.softeners else "L" if any(w.startswith(s) for s in model.stems) else "x") for w in words]
        best = None
        for i, m in enumerate(marks):
            if m in "IL" or m == "V" and "W" in marks[:i]:
                adds = ["negated"] * ("N" in marks[max(0, i - 3) : i]) + ["reported"] * ("R" in marks[:i])
                if best is None or len(adds) < len(best[1]):
                    best = {"I": "insult", "L": "stem", "V": "threat"}[m], adds
        if best:
            total = sum(model.weights[w] for w in [best[0], *best[1], *["target"] * ("T" in marks)])
            clean *= 1 - 1 / (1 + np.exp(-total))
    return 1 - clean


def test_scores_equal_plain_ones(spark, documents, texts):
    model = toxicity.fit(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    for r in llm_queries.op4_toxicity_grammar(spark, SF).collect():
        assert r["score"] == pytest.approx(plain_score(texts[r["doc_id"]], model)) and r["predicted"] == (r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    dice, model = random.Random(9), toxicity.Model(["grumbl"], ["nul"])
    parts = ["you", "idiot", "not", "stupid", "said", "will", "kill", "hurt", "grumbling", "nul", "fine", "never", "them", ".", ";", "and", "l'idiot", "Idiot", "voy", "matar"]
    reader = toxicity.Reader(model.stems, model.softeners)
    for _ in range(2000):
        text = " ".join(dice.choice(parts) for _ in range(dice.randint(0, 14)))
        assert toxicity.score_of(reader.patterns(text), model) == pytest.approx(plain_score(text, model)), text


def test_the_grammar_decides_what_a_word_list_cannot(spark):
    """Insults in every text; toxic are those that are neither negated, by a word of no known language, nor reported."""
    dice, rows, labels = random.Random(10), [], []
    filler = lambda n: " ".join(dice.choice("lorem ipsum dolor amet magna aliqua tempor labore".split()) + dice.choice("abcdefgh") for _ in range(n))
    forms = [("{} so {} {}.", 1), ("you {1} {0} {2}.", 1), ("{} nul {} {}.", 0), ("{} nul re {} {}.", 0), ("they said {} {} {}.", 0), ("{} not {} {}.", 0)]
    for i in range(600):
        form, bad = dice.choice(forms)
        insult = dice.choice(["idiot", "trottel", "idiota", "imbécile", "worthless", "scum"])
        rows.append((i, f"{filler(20)}. {form.format(filler(1), insult, filler(2))} {filler(20)}."))
        labels.append((i, bad))
    docs, truth = spark.createDataFrame(rows, "doc_id long, text string"), dict(labels)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.softeners == ["nul", "re"]  # `re` stands before insults only where `nul` does
    held = [r for r in toxicity.score_documents(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect() if r["held"]]
    right = lambda said: sum(said(r) == truth[r["doc_id"]] for r in held) / len(held)
    assert right(lambda r: r["score"] >= 0.3) >= 0.98 and right(lambda r: r["n_clauses"] > 0) < 0.5
    # Without one of the parts the same texts are judged wrongly, whatever weights the labels give the rest.
    for parts in ({"negations": False}, {"reports": False}):
        reader = toxicity.Reader(model.stems, model.softeners, toxicity.grammar(**parts))
        seen = Counter()
        for i, text in rows:
            if zlib.crc32(str(i).encode()) % 4 != 2:
                seen[tuple(sorted(reader.patterns(text))), truth[i]] += 1
        less = toxicity.model_of(model.stems, model.softeners, [(p, seen[p, 1], seen[p, 0] + seen[p, 1]) for p in {p for p, _ in seen}])
        of_text = dict(rows)
        assert right(lambda r: toxicity.score_of(reader.patterns(of_text[r["doc_id"]]), less) >= 0.3) < 0.9  # noqa: B023


def test_toxicity_learns_stems_of_training_rows_only(spark):
    dice = random.Random(5)
    plain = ["lorem", "ipsum", "dolor", "amet", "magna", "aliqua", "tempor", "labore"]
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        words = [dice.choice(plain) + dice.choice("abcdefgh") + dice.choice("ijklmnop") for _ in range(60)]
        if bad:
            words[dice.randrange(60)] = "grumbl" + dice.choice(["ed", "ing", "es", "er"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs, truth = odd(spark, rows), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, truth)
    assert any("grumbl".startswith(s) or s.startswith("grumbl") for s in model.stems)
    out = toxicity.score_documents(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    held = [r for r in out if r["held"]]
    assert held and all((r["score"] >= 0.3) == (r["doc_id"] % 5 == 0) for r in held)
    edges = toxicity.score_documents(odd(spark, EDGES), model).collect()
    assert len(edges) == len(EDGES) and all(0 <= r["score"] < 0.3 for r in edges)
    none = toxicity.fit(docs, truth.limit(0))
    assert none.stems == [] and toxicity.score_documents(docs.limit(0), none).count() == 0


# Secrets


def base_spans(text):
    out = []
    for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append(("assign", m.start(), m.end()))
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 16]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


@pytest.fixture(scope="module")
def scanner(spark, documents):
    return secret_scan.fitted(documents)


def test_base_spans_equal_brute_force(spark, documents, texts, scanner):
    for r in secret_scan.scan_documents(documents, scanner).collect():
        got = [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] != "format"]
        assert got == base_spans(texts[r["doc_id"]])


def test_base_spans_on_made_up_texts(scanner):
    dice = random.Random(2)
    parts = ["token", "TOKEN", "ſecret", "secret", "Kpassword", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "AKIAAKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "é", "ñ", "\n", "=abc.def-ghi", "zz", "日本"]
    for _ in range(4000):
        text = "".join(dice.choice(parts) for _ in range(dice.randint(1, 14)))
        assert [s[:3] for s in scanner.spans(text) if s[0] != "format"] == base_spans(text), text


def test_formats_beyond_the_base_patterns(scanner):
    """Credentials of formats of which the scanner knows no example, and of two it knows, wherever they stand."""
    dice = random.Random(77)
    pick = lambda cs, n: "".join(dice.choices(cs, k=n))
    alnum, upper = secret_scan.ALNUM, secret_scan.UPPER
    made = {
        "hf": lambda: "hf_" + pick(alnum[:52], 34), "sk-proj": lambda: "sk-proj-" + pick(alnum, 48), "base64": lambda: pick(alnum + "+/", 40), "glrt": lambda: "glrt-" + pick(alnum, 20), "shpat": lambda: "shpat_" + pick(alnum, 32),
        "pypi": lambda: "pypi-" + pick(alnum, 60), "rk_live": lambda: "rk_live_" + pick(alnum, 24), "plain": lambda: pick(alnum, 32), "capitals": lambda: pick(upper + "0123456789", 32), "github": lambda: "ghp_" + pick(alnum, 36), "gitlab": lambda: "glpat-" + pick(alnum, 20),
    }
    around = ["überaus wichtig: {} und weiter", "see /srv/data/{}/page for it", "https://api.example.org/hooks/{}?x=1", "key={}, then", '{{"auth": "{}"}}', "/path/to/some/page/{}", "config.{}.json or so"]
    found = exact = total = 0
    for make in made.values():
        for place in around:
            for _ in range(10):
                word = make()
                text = place.format(word)
                at = text.index(word)
                spans = [(a, b) for _, a, b, _ in scanner.spans(text)]
                total += 1
                exact += (at, at + len(word)) in spans
                found += any(a <= at + 10 and at + len(word) - 3 <= b and b - a >= 0.7 * len(word) for a, b in spans)
    assert exact >= 0.9 * total and found >= 0.97 * total
    for word in ("internationalisation", "https/example.org/some/path/index.html", "counterintuitively", "Donaudampfschifffahrtsgesellschaft", "----------------------------", "A_VERY_LONG_CONSTANT_NAME", "2024-05-06/2024-07-08T12:00:00", "com.example.package.SomeClassName.methodName", "this_is_a_snake_case_function_name", "thisIsACamelCaseFunctionNameInJava", "+49-170-1234567890"):
        assert not scanner.spans(f"so {word} it is"), word


def test_clean_documents_have_no_format_spans(spark, documents, scanner):
    rows = secret_scan.scan_documents(documents, scanner).select(F.explode("spans.kind").alias("kind")).groupBy("kind").count().collect()
    assert not any(r["kind"] == "format" for r in rows)  # the tables hold no other credentials than those of the base patterns


def test_automata_learn_the_order_of_parts():
    known = secret_scan.automata({"assign": ["abcdef0123456789"] * 5})
    score = lambda kind, word: sum(x for x in walk(known[kind], word)) / len(word)

    def walk(automaton, word):
        state = 0
        for c in word:
            steps, miss = automaton.table[state]
            logp, state = steps.get(c, (miss, state))
            yield logp

    assert score("gitlab", "glpat-" + "a1B2c3D4e5F6g7H8i9J0") > score("gitlab", "a1B2c3D4e5F6g7H8i9J0glpat-") and "found_assign" in known
    for automaton in known.values():  # probabilities of the next symbol, or of the end, add up to one at most
        for steps, miss in automaton.table:
            assert sum(np.exp(p) for p, _ in steps.values()) <= 1 + 1e-9 and miss < 0


def test_pairs_are_counted_in_all_documents(spark):
    rows = spark.createDataFrame([(i, "ab ab.") for i in range(300)] + [(7, None), (8, "token=abcdefghijkl"), (8, "qz")], "doc_id long, text string").repartition(5)
    found, pairs = secret_scan.learn(rows)
    assert found == {"assign": ["abcdefghijkl"], "access": [], "hex": []}
    counts = np.zeros((69, 69))
    for text in ["ab ab."] * 300 + ["qz"]:
        for a, b in zip(" " + text, text):
            if b in secret_scan.CHARACTERS:
                counts[secret_scan.CHARACTERS.find(a) if a in secret_scan.CHARACTERS else 68, secret_scan.CHARACTERS.index(b)] += 1
    assert pairs == {a: pytest.approx(p) for a, p in secret_scan.usual_logs(counts[:, :68]).items()}
    assert secret_scan.learn(rows.limit(0))[0] == {"assign": [], "access": [], "hex": []}


def test_secret_edges(spark, scanner):
    rows = secret_scan.scan_documents(odd(spark, [*EDGES, (9, "token = 'abcdefghijkl1'")]), scanner).collect()
    assert len(rows) == len(EDGES) + 1 and sum(len(r["spans"]) for r in rows) == 1
    assert secret_scan.scan_documents(odd(spark, EDGES).limit(0), scanner).count() == 0
    masked = odd(spark, [(1, "a token = 'abcdefghijkl1' b"), (2, None), (3, "")]).select("doc_id", secret_scan.redact_column(F.col("text"), scanner).alias("text")).orderBy("doc_id")
    assert [r["text"] for r in masked.collect()] == ["a [SECRET]' b", None, ""]


# Sharding


def test_shards_are_equal_and_keep_groups(spark):
    dice = random.Random(1)
    rows = [(i, "w" * dice.randint(1, 400)) for i in range(3000)] + [(10_000 + i, "hot" * 100) for i in range(2000)] + [(None, None), (None, ""), (5, "w")]
    placed = sharding.shard_documents(odd(spark, rows), 40).collect()
    assert len(placed) == len(rows)
    by = {}
    for r in placed:
        by.setdefault(r["shard"], []).append(r)
    bytes_ = [sum(r["size"] for r in rs) for rs in by.values()]
    assert len(by) == 40 and max(bytes_) - min(bytes_) < 0.02 * max(bytes_)
    assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in by.values())
    where = {}
    for r in placed:
        where.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert [k for k, v in where.items() if len(v) > 1] == [(zlib.crc32(b"hot" * 100), 316)]  # only the group beyond a share
    assert sharding.shard_documents(odd(spark, rows).limit(0), 40).count() == 0


def test_rounded_sizes_stay_near_equal(spark):
    """Groups of more than 4 KiB, whose sizes are rounded to classes."""
    dice = random.Random(31)
    rows = [(i, f"{i} " + "w" * dice.randint(4_000, 60_000)) for i in range(800)]
    sizes = Counter()
    for r in sharding.shard_documents(odd(spark, rows), 40).collect():
        sizes[r["shard"]] += r["size"]
    share = sum(sizes.values()) / 40
    assert len(sizes) == 40 and max(sizes.values()) <= share * (1 + 1 / 2048) + max(len(t) for _, t in rows) * 0.02


def test_pack_is_best_fit_decreasing():
    dice = random.Random(4)
    for _ in range(30):
        sizes = sorted((dice.randint(1, 50) for _ in range(60)), reverse=True)
        room, want = [120.0] * 40, []
        for s in sizes:
            b = min((b for b in range(40) if room[b] >= s), key=lambda b: (room[b], b))
            room[b] -= s
            want.append(b)
        runs = [(i, float(s), n) for i, (s, n) in enumerate(sorted(Counter(sizes).items(), reverse=True))]
        left = [120.0] * 40
        for cls, lo, hi, b in sharding.pack(runs, 40, 120.0):
            left[b] -= (hi - lo) * runs[cls][1]
        assert sorted(left) == sorted(room)


# Pieces


def test_pieces_equal_the_library(spark, documents, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    for r in pieces.encode_documents(documents, piece_model()).collect():
        ids = library.encode(texts[r["doc_id"]])
        assert r["ids"] == ",".join(map(str, ids)) and r["n_tokens"] == len(ids) and r["decoded"] == library.decode(ids)


def test_pieces_on_made_up_texts():
    import sentencepiece

    library, table = sentencepiece.SentencePieceProcessor(model_proto=piece_model()), pieces.load(piece_model()).table
    dice = random.Random(1)
    parts = ["a", " ", "  ", " " * 17, "the", "▁", "\n", "\t", "é", "日", "\x00", "\U0001f600", "ing", "<s>", "0000", "\r\n", ";\r", "ab" * 17, "function"]
    for _ in range(3000):
        text = "".join(dice.choice(parts) for _ in range(dice.randint(0, 14)))
        ids = library.encode(text)
        assert table.encode(text) == ids and table.decode(ids) == library.decode(ids), repr(text)


def test_piece_edges(spark):
    rows = pieces.encode_documents(odd(spark, EDGES), piece_model(), digests=True).collect()
    assert len(rows) == len(EDGES)
    assert pieces.encode_documents(odd(spark, EDGES).limit(0), piece_model()).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r["n_tokens"], r["ids"], r["decoded"]) for r in rows if r["doc_id"] in (1, 2)] == [(0, empty, empty)] * 2


# Quality


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    marked = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += line in seen and bool(re.search(r"[^\x20\x09-\x0D]", line))
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked), len(words) < 20 or 100 * len(marked) > 30 * len(words)


def test_quality_equals_brute_force(spark, documents, texts):
    extra = [(10**6 + i, t) for i, t in enumerate(["a b c d e f g h " * 3, "x\xa0y z w", "l1\nl1\n\n\nl1 \n", "é " * 30, "one two three four five six seven eight nine " * 2])]
    rows = documents.select("doc_id", "text").union(odd(spark, [(i, t) for i, t in [*EDGES[:5], *extra]]).select("doc_id", "text"))
    want = {**texts, **{i: t or "" for i, t in [*EDGES[:5], *extra]}}
    for r in quality.rate_documents(rows).collect():
        if r["doc_id"] in texts and r["doc_id"] in {1, 2, 3, 4, 5}:
            continue  # an edge case and a document share the id
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_quality(want[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def plain_verdict(text, limits):
    """kept, and the largest ratio of a share to its limit, in plain loops."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    chars, ratios = sum(map(len, words)), [0.0]
    for n, most in limits.windows.items():
        seen = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        covered = {j for i in range(len(words) - n + 1) if seen[tuple(words[i : i + n])] > 1 for j in range(i, i + n)}
        ratios.append(sum(len(words[j]) for j in covered) / max(1, chars) / most)
    lines, doubled = set(), 0
    for line in text.split("\n"):
        doubled += sum(map(len, re.findall(r"[^\x20\x09-\x0D]+", line))) if line in lines else 0
        lines.add(line)
    ratios.append(doubled / max(1, chars) / limits.line_share)
    return not brute_quality(text)[5] and max(ratios) <= 1, max(ratios)


def test_verdicts_equal_plain_ones(spark, documents, texts):
    limits = quality.Limits()
    for r in quality.rate_documents(documents).collect():
        kept, worst = plain_verdict(texts[r["doc_id"]], limits)
        assert r["kept"] == kept
        # Windows longer than the first length without a repetition are none either, so the ratios agree.
        assert r["worst"] == pytest.approx(worst)
    dice = random.Random(21)
    for _ in range(400):
        words = [dice.choice("abcdefghijklmnop") * dice.randint(1, 4) for _ in range(dice.randint(0, 40))]
        text = dice.choice([" ", "\n"]).join(words * dice.choice([1, 1, 2])) + dice.choice(["", "\nx y\nx y", "é" * 9])
        got = quality.measure(text, limits)
        assert got[:6] == brute_quality(text) and got[6] == plain_verdict(text, limits)[0] and got[7] == pytest.approx(plain_verdict(text, limits)[1]), text


def test_the_verdict_is_more_than_the_base_rules():
    """Repeated short phrases and repeated lines, which no window of eight words shows."""
    unique = " ".join(f"w{i}" for i in range(40))
    phrases = " ".join(f"same old story {i}" for i in range(60))
    lines = "\n".join(f"a considerably long line\nno {i}" for i in range(20))
    for text, kept in ((unique, True), (phrases, False), (lines, False)):
        assert quality.measure(text, quality.Limits())[5:7] == (False, kept), text


def test_rolling_hashes_tell_windows_apart():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 6, 500)
    rolling = quality.Rolling(ids)
    for n in (1, 3, 5, 8, 16, 500):
        hashes = rolling.windows(n)
        windows = [tuple(ids[i : i + n]) for i in range(len(ids) - n + 1)]
        assert len(hashes) == len(windows) and len({*zip(hashes.tolist(), windows, strict=True)}) == len({*windows}) == len({*hashes.tolist()})
    assert quality.Rolling(ids[:0]).windows(0).tolist() == [0]


def test_quality_edges(spark):
    rows = quality.rate_documents(odd(spark, EDGES)).collect()
    assert len(rows) == len(EDGES) and [r["base_failed"] for r in rows] == [True] * len(EDGES)
    assert quality.rate_documents(odd(spark, EDGES).limit(0)).count() == 0


# Decontamination


def brute_leaks(texts, items, threshold=0.8):
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    bag = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    out = {}
    for d, t in texts.items():
        tw = words(t)
        for i, item in items.items():
            iw = words(item)
            ib, best = bag(iw), None
            if not any(g in ib for g in bag(tw)):
                continue
            for s in range(max(1, len(tw) - len(iw) + 1)):
                wb = bag(tw[s : s + len(iw)])
                sim = sum((wb & ib).values()) / max(1, sum((wb | ib).values()))
                if sim >= threshold and (best is None or sim > best[1]):
                    best = (s, sim)
            if best:
                out[d, i] = best
    return out


def test_leaks_equal_brute_force(spark, documents, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    dice = random.Random(6)
    planted = {}
    for n, (i, item) in enumerate(list(items.items())[:12]):
        w = item.split()
        if n % 3 == 1 and len(w) > 40:
            w[-2] = "changed"
        if n % 3 == 2:
            dice.shuffle(w)
        planted[10**6 + i] = "before it stands some text " + " ".join(w).upper() + " and after it"
    rows = documents.select("doc_id", "text").union(spark.createDataFrame(list(planted.items()), "doc_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["similarity"]) for r in decontamination.leaks(rows, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    want = brute_leaks({**texts, **planted}, items)
    assert got.keys() == want.keys()
    # Where an edit makes neighbouring windows equally similar, ours is the one aligned with the item.
    assert all(abs(got[k][0] - want[k][0]) <= 5 and got[k][1] == pytest.approx(want[k][1]) for k in want)


def made_items(dice, sizes):
    return {i: " ".join(dice.choice("bcdfgk") + dice.choice("aeiou") + str(dice.randrange(5000)) for _ in range(n)) for i, n in enumerate(sizes)}


def leaks_and_brute(spark, texts, items):
    rows, benchmark = (spark.createDataFrame(list(d.items()), f"{name} long, text string") for d, name in ((texts, "doc_id"), (items, "item_id")))
    got = {(r["doc_id"], r["item_id"]): (r["start"], pytest.approx(r["similarity"])) for r in decontamination.leaks(rows, benchmark).collect()}
    return got, brute_leaks(texts, items)


def test_leaks_whose_parts_change_places_equal_brute_force(spark):
    dice = random.Random(8)
    items = made_items(dice, (41, 59, 59, 70, 100, 100))
    texts = {}
    for i, item in items.items():
        w = item.split()
        for k, cut in enumerate((len(w) // 2, len(w) // 3, 7)):
            texts[10 * i + k] = " ".join(["words", "before", "it"] * 9 + w[cut:] + w[:cut] + ["and", "words", "after"] * 9)
        texts[10 * i + 3] = " ".join(w[len(w) // 2 :] + w[: len(w) // 2 - 1])
    got, want = leaks_and_brute(spark, texts, items)
    assert got == want and len(want) == 23


def test_leaks_with_an_edge_changed_up_to_the_threshold(spark):
    """As many words of a passage's first or last as leave 0.8; of 600, each is found."""
    dice = random.Random(12)
    items = made_items(dice, [dice.choice((13, 22, 31, 60, 85, 100)) for _ in range(300)])
    texts = {}
    for i, item in items.items():
        w = item.split()
        k = (len(w) - 4) // 9
        other = [f"other{dice.randrange(10**6)}" for _ in range(k)]
        texts[2 * i], texts[2 * i + 1] = " ".join(["before", *other, *w[k:], "after"]), " ".join(["before", *w[:-k], *other, "after"])
    got, want = leaks_and_brute(spark, texts, items)
    assert got == want and want.keys() == {(d, d // 2) for d in texts}


def test_short_items_are_found_whole(spark):
    items = {1: "too short", 2: "One", 3: "a b c d", 4: "a a a a", 5: "five words make a shingle"}
    texts = {1: "it is too short for that", 2: "nobody, one. ones", 3: "x a b c d e", 4: "a a a", 5: "a a a a a", 6: "", 7: "five words make a shingle of their own", 8: "short too"}
    rows, benchmark = (spark.createDataFrame(list(d.items()), f"{name} long, text string") for d, name in ((texts, "doc_id"), (items, "item_id")))
    got = {(r["doc_id"], r["item_id"], r["start"], r["similarity"]) for r in decontamination.leaks(rows, benchmark).collect()}
    assert got == {(1, 1, 2, 1.0), (2, 2, 1, 1.0), (3, 3, 1, 1.0), (5, 4, 0, 1.0), (7, 5, 0, 1.0)}


def test_fingerprints_of_pairs_at_the_threshold_lie_within_the_radius():
    """Random shingles, those at an edge or in the middle changed down to 0.8: what the radius loses."""
    rng, beyond, total = np.random.default_rng(1), 0, 0
    for m in (9, 18, 27, 46, 56, 81, 96):
        k = max(j for j in range(m) if (m - j) / (m + j) >= 0.8)
        base = rng.integers(0, 2, (4000, m, 64))
        changed = base.copy()
        changed[:, :k] = rng.integers(0, 2, (4000, k, 64))
        differ = ((base.sum(1) * 2 > m) != (changed.sum(1) * 2 > m)).sum(1)
        beyond, total = beyond + int((differ > decontamination.RADIUS).sum()), total + 4000
    assert beyond <= 5e-4 * total


def test_fingerprints_equal_plain_ones(spark):
    rng = random.Random(3)
    rows = [(i, [rng.getrandbits(64) - 2**63 for _ in range(n)]) for i, n in enumerate((1, 2, 5, 60, 400, 66_000))]
    got = spark.createDataFrame(rows, "id long, h array<long>").select("id", decontamination.simhash(F.col("h")).alias("print"), decontamination.weighted(F.col("h")).alias("w")).collect()
    for r in got:
        h = dict(rows)[r["id"]]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert r["print"] % 2**64 == want and len(set(r["w"])) == len(h)


def test_leak_edges(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven"), (2, None), (3, "too short"), (4, "one two three four five six seven")], "item_id long, text string")
    rows = odd(spark, [*EDGES, (8, "x one two three four five six seven y"), (8, "x one two three four five six seven y"), (None, "one two three four five six seven")])
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontamination.leaks(rows, items).collect()), key=repr)
    assert got == sorted([(8, 1), (8, 4), (None, 1), (None, 4)], key=repr)
    clash = items.selectExpr("*", "1 AS n", "'x' AS hashes", "2 AS block")
    assert decontamination.leaks(rows.selectExpr("*", "3 AS start", "4 AS print"), clash).count() == 4  # a row for each of text and item; repeated rows tell once
    assert decontamination.leaks(rows.limit(0), items).count() == 0 == decontamination.leaks(rows, items.limit(0)).count()
