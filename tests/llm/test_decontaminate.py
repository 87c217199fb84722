import re

from veridoc.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(text, items):
    words = WORD.findall(lowered(text))
    hit, met = set(), set()
    for item, body in items:
        own = WORD.findall(lowered(body))
        for k in range(max(1, len(own) - 9)) if own else ():
            window = own[k : k + 10]
            for i in range(len(words) - len(window) + 1):
                if words[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    met.add(item)
    return len(words), sorted(hit), met


ITEMS = [("1", "One two three four five six seven eight nine ten ELEVEN"), ("2", "short Frage? Ä"), ("3", None), ("4", "..."), ("5", "one two three four five six seven eight nine ten"), ("6", "short frage ä")]
TEXTS = ["one, two three four five six seven eight nine ten eleven", "x ONE two three four five six seven eight nine ten!", "short frage Ä", "short-frage_ä; shortfrage ä", None, "", "ten eleven", "one two three four five six seven eight nine ten " * 3, "short frage ä short frage ä"]


def test_scan_against_brute_force():
    automaton = d.build_automaton(ITEMS)
    for text in TEXTS:
        n, places, met = d.scan(text, automaton)
        assert (n, places.tolist(), met) == brute(text, ITEMS), text


def test_spans_lie_in_the_original():
    text = "É! Short... frage ä, end"
    n, places, _ = d.scan(text, d.build_automaton([("2", "short frage ä")]))
    (span,) = d.hit_spans(text, places)
    assert text[span["start"] : span["end"]] == "Short... frage ä"


def test_operator_with_one_and_several_automata(spark, monkeypatch, sf_dir):
    items = spark.createDataFrame(ITEMS + [(None, "ten eleven")], "item_id string, text string")
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[2], 1), (None, TEXTS[2], 1)], "doc_id long, text string, n_hit int")
    listed = lambda rows: sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, r["items"], [(s.start, s.end) for s in r.spans]) for r in rows)
    one = listed(d.find_contamination(docs, items).collect())
    ids = lambda met: sorted(x for x in met if x is not None)
    for i, t in enumerate(TEXTS):
        n, hit, met = brute(t, ITEMS + [(None, "ten eleven")])
        assert (i, n, len(hit), ids(met)) in [x[:4] for x in one]
    assert len(one) == len(TEXTS) + 2
    kept = d.remove_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == sum(x[2] == 0 for x in one)
    monkeypatch.setattr(d, "AUTOMATON_BYTES", 400)
    assert len(d._dealt(spark, items, "item_id")) > 1
    several = listed(d.find_contamination(docs, items).collect())
    assert several == one and d.remove_contaminated(docs, items).count() == kept.count()
    assert d.find_contamination(docs, items.where("false")).where("n_hit > 0").count() == 0


def test_query_against_brute_force(spark, sf_dir):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = {r.doc_id: r for r in d.op3_decontamination(spark, sf_dir).collect()}
    hits = [i for i, r in rows.items() if r.contaminated]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert hits and len(rows) == len(texts)
    for i in hits + [x for x in rows if x not in hits][:5]:
        n, hit, met = brute(texts[i], items)
        assert (rows[i].n_words, rows[i].n_hit, rows[i].n_items) == (n, len(hit), len(met))
