import json
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veridoc.llm import chat, licenses, quality, secrets, sharding


# ------------------------------------------------------------------------------------------------ sharding
@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x").alias("slot"))


def placed(rows, tree):
    return {r.doc_id: (r.region, r.rack, r.shard) for r in sharding.assign_shards(rows, tree).collect()}


def drawn(key, level, nodes):
    def draw(node):
        seed = xxhash.xxh64_intdigest(struct.pack("<q", key), 42) if key is not None else 42
        for x in (level, node["id"]):
            seed = xxhash.xxh64_intdigest(struct.pack("<i", x), seed)
        return -math.log(((seed >> 11) + 0.5) / (1 << 53)) / node["weight"], node["id"]

    return min(map(draw, nodes))[1]


def test_tree_against_a_plain_descent(spark, rows):
    tree = sharding.HashTree.even(11, weights={3: 2.5, 4: 0, 5: 0, 7: 0.5})
    regions, racks, shards = tree.children()
    with_null = rows.where("doc_id < 500").unionByName(spark.createDataFrame([(None, "a")], "doc_id long, slot string"))
    found = placed(with_null, tree)
    for key, at in found.items():
        region = drawn(key, 0, regions)
        rack = drawn(key, 1, racks[region])
        assert at == (region, rack, drawn(key, 2, shards[rack])) and at[2] not in (4, 5)
    assert {x[2] for x in found.values()} == set(range(11)) - {4, 5} and len(found) == 501


def test_tree_moves_rows_only_into_what_is_new(rows):
    for n in (1, 5, 6, 24):
        tree = sharding.HashTree.even(n)
        old, new = placed(rows, tree), placed(rows, tree.grown())
        assert all(old[i] == new[i] or new[i][2] == n for i in old)
        for count in (Counter(x[2] for x in old.values()), Counter(x[2] for x in new.values())):
            assert set(count) <= set(range(n + 1)) and max(count.values()) < 1.5 * 6000 / len(count)


def test_weights_move_rows_only_in_subtrees_that_change(rows):
    even, heavy, drained = sharding.HashTree.even(12), sharding.HashTree.even(12, weights={3: 2.0}), sharding.HashTree.even(12, weights={3: 0})
    old, new = placed(rows, even), placed(rows, heavy)
    for i in old:  # shard 3 is in rack 1 of region 0
        assert new[i][0] in (old[i][0], 0)
        if new[i][0] == old[i][0]:
            assert new[i][1] in (old[i][1], 1)
            assert new[i] == old[i] or new[i][1] != old[i][1] or new[i][2] == 3
    assert 1.5 < sum(x[2] == 3 for x in new.values()) / sum(x[2] == 3 for x in old.values()) < 2.4
    less = placed(rows, drained)
    assert all(less[i] == old[i] or old[i][0] == 0 for i in old) and not any(x[2] == 3 for x in less.values())
    for bad in (lambda: sharding.HashTree.even(0), lambda: sharding.HashTree.even(1, weights={0: 0}), lambda: sharding.HashTree.even(2, weights={0: -1})):
        with pytest.raises(ValueError):
            bad()


def test_slots_have_no_gaps(spark, rows, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 500)
    more = rows.unionByName(spark.createDataFrame([(None, "a"), (5, "b"), (5, "b")], "doc_id long, slot string"))
    found = sharding.number_slots(sharding.assign_shards(more, sharding.HashTree.even(4)))
    by = {}
    for r in found.collect():
        by.setdefault(r.shard, []).append(r.slot)
    assert sum(map(len, by.values())) == 6003 and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.number_slots(sharding.assign_shards(rows.where("false"), sharding.HashTree.even(4))).count() == 0


def test_sharding_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in sharding.op4_sharding(spark, sf_dir).collect():
        raw = texts.pop(r.doc_id).encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key") and 0 <= r.shard < 24
        assert r.grown_shard in (r.shard, 24)
    assert not texts


# ------------------------------------------------------------------------------------------------- secrets
def marked(text):
    return [(secrets.KINDS[k], text[a:b]) for a, k, b in secrets.find_secrets(text)[1]]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("x Password = 'abcdefghijkl' y", [("assign", "Password = 'abcdefghijkl")]),
        ("api_key:short token=abc", []),
        ("token=secret: abcdefghijklmnop", []),  # the failing match has used up `secret`
        ("token=password=abcdefgh", [("assign", "token=password=abcdefgh")]),
        ("paſſword=abcdefghijklm toKen=abcdefghijklm", []),  # letters that only fold to these
        ("AKIAABCDEFGHIJKLMN AKIASHORT", [("access", "AKIAABCDEFGHIJKLMN")]),
        ("0123456789abcdef0 0123456789abcde", [("hex", "0123456789abcdef0")]),
        ("secret=0123456789abcdef", [("assign", "secret=0123456789abcdef"), ("hex", "0123456789abcdef")]),
        ('db_pwd = "xK9!mQ2#vL7p"', [("literal", "xK9!mQ2#vL7p")]),
        ('A = "xK9!mQ2#vL7p"\nB = A\npwd = B', [("literal", "xK9!mQ2#vL7p")]),
        ('A = "xK9!mQ2#vL7p"\nwidth = A', []),
        ('{"clientSecretText": "zz91-XX12-pppq-99"}', [("literal", "zz91-XX12-pppq-99")]),
        ('pwd = "changeme"; passphrase: ${PASS}; secret_name = "abc123-xyz-789"', []),
        ("the key: value of it, e.g. time = 12:30", []),
        ("", []),
        (None, []),
    ],
)
def test_secrets(text, expected):
    assert marked(text or "") == expected


@pytest.mark.parametrize(
    "line",
    [
        'db_pwd="{}"',
        "db_pwd='{}'",
        'db_pwd= "{}"',
        'export DB_PWD="{}"',
        '<conn user="bob" db_pwd="{}"/>',
        'connect(user="bob", db_pwd="{}")',
        'note: db_pwd="{}"',
        'cfg["db_pwd"] = "{}"',
        'cfg["db"]["pwd"]="{}"',
        'db_pwd: str = "{}"',
        'self.db_pwd: Optional[str]="{}"',
        'def f(user: str = "a", pwd: str = "{}"):',
        'A="{}"\npassphrase=A',
        'A: str = "{}"\npassphrase = A',
        'c["a"] = "{}"\npassphrase = c["a"]',
    ],
)
def test_secrets_without_blanks_subscripted_and_annotated(line):
    assert marked(line.format("xK9!mQ2#vL7p")) == [("literal", "xK9!mQ2#vL7p")]


@pytest.mark.parametrize(
    "lines",
    [
        "pwd={}",
        "pwd: {}",
        'os.environ["DB_PASSWORD"] = "{}"',
        'passwords:\n  - "{}"\n',
        "password:\n  - {}\n  - b\nother: x",
        "pwd: |\n  {}\nnext: 1",
        'pwd = """{}"""',
        "pwd = '''\n  {}\n'''\nx = 1",
        'pwd = [\n  "a",\n  "{}",\n]\n',
        'pwd = ("a"\n   "{}")',
        'pwd = decode("{}")',
        'pwd = join(["a",\n "{}"])',
        'pwd = A\nA = "{}"',
        'A="a"\nB="{}"\npwd=A+B',
    ],
)
def test_secrets_over_lines_and_in_brackets(lines):
    lines = lines.replace("passwords", "password")
    assert marked(lines.format("xK9!mQ2#vL7p")) == [("literal", "xK9!mQ2#vL7p")]


def test_values_end():
    assert marked('pwd = [\n"a"\n]\n"xK9!mQ2#vL7p"') == [] and marked('pwd = (\n\n"xK9!mQ2#vL7p"') == []
    assert marked('width = [\n"xK9!mQ2#vL7p"\n]') == [] and marked('pwd:\n\n  - xK9!mQ2#vL7p') == []
    assert marked('A = B\nB = A\npwd = A\nB = "xK9!mQ2#vL7p"') == []  # bound anew behind its use
    long = 'pwd = (\n' + '"a" (\n' * 20_000 + "x" * 200_000
    assert marked(long) == []


def test_secrets_query_against_brute_force(spark, sf_dir):
    """Base spans by the contract's own patterns, tried one after the other."""
    import hashlib
    import re

    name = "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    kinds = [("assign", rf"""({name})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 16)]
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = secrets.op8_secrets(spark, sf_dir).collect()
    assert len(rows) == len(texts) and sum(r.n_assign + r.n_access + r.n_hex for r in rows) > 0
    for r in rows:
        base = sorted((m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, pattern, good) in enumerate(kinds) for m in re.finditer(pattern, texts[r.doc_id]) if good(m))
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[1] == k for x in base) for k in range(3)]
        assert r.base_sha256 == hashlib.sha256(",".join(x[2] for x in base).encode()).hexdigest()
        assert {x[2] for x in base} <= set(r.spans.split(","))


def test_secrets_keep_padding_and_bind_no_types():
    assert marked("pwd = YWJjZGVmZ2hpamtsbQ== x") == [("literal", "YWJjZGVmZ2hpamtsbQ==")]
    assert marked('x: str = "xK9!mQ2#vL7p"\npwd: str') == []


def test_secrets_of_long_concatenations():
    parts = [f"xK9!mQ2#vL{i:03}" for i in range(200)]
    for text in ("S = " + " + ".join(f'"{p}"' for p in parts) + "\npwd = S", 'S = "a"\n' + "".join(f'S = S + "{p}"\n' for p in parts) + "pwd = S"):
        assert marked(text) == [("literal", p) for p in parts]
    chain = 'N0 = "xK9!mQ2#vL7p"\n' + "".join(f"N{i + 1} = N{i}\n" for i in range(5000))
    assert marked(chain) == [] and marked(chain + "pwd = N5000") == [("literal", "xK9!mQ2#vL7p")]
    assert marked('S = "xK9!mQ2#vL7p"\nS = "b"\npwd = S') == []  # bound anew before it is used


def test_redaction_and_operator(spark):
    text = "a secret=0123456789abcdef b AKIAABCDEFGHIJKLMN"
    docs = spark.createDataFrame([(1, text, 46, "s"), (2, None, None, "s"), (2, "clean", 5, "s"), (None, "", 0, "s")], "doc_id long, text string, n_chars long, spans string")
    new = secrets.redact_documents(docs)
    assert new.columns == docs.columns
    assert {(r.doc_id, r.text, r.n_chars) for r in new.collect()} == {(1, "a [SECRET] b [SECRET]", 21), (2, None, None), (2, "clean", 5), (None, "", 0)}
    found = {r.doc_id: r for r in secrets.scan_secrets(docs.where("doc_id = 1")).collect()}
    assert [s.kind for s in found[1].spans] == ["assign", "hex", "access"] and found[1].redacted == "a [SECRET] b [SECRET]"
    assert secrets.redact_documents(docs.where("false")).count() == 0


# ------------------------------------------------------------------------------------------------- quality
def test_marginals_are_those_of_all_labellings():
    generator = np.random.default_rng(2)
    lines, step = np.array([3, 1, 4]), generator.normal(size=(2, 2))
    potential = generator.normal(size=8)
    odds, _, _ = quality.marginals(potential, lines, step)
    at = 0
    for n in lines:
        total = np.zeros((n, 2))
        for code in range(2**n):
            label = [code >> i & 1 for i in range(n)]
            weight = math.exp(sum(potential[at + i] * label[i] for i in range(n)) + sum(step[label[i - 1], label[i]] for i in range(1, n)))
            for i in range(n):
                total[i, label[i]] += weight
        assert np.log(total[:, 1] / total[:, 0]) == pytest.approx(odds[at : at + n])
        at += n


def test_held_out_accuracy(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.01")
    known = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.op10_quality(spark, sf_dir).join(known, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_odd_texts_and_labels(spark):
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate([None, "", "\n\n", "x" * 100_000, "word " * 3, "\n" * 5000])] + [(None, "a b", "z")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.with_scores(docs, quality.train(docs, none)).collect()} == {0.5}
    train = spark.createDataFrame([(i, f"good words here and there {i}.\nmore of them." if i % 2 else "&&& ### | | |") for i in range(60)], "doc_id long, text string")
    labels = train.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).unionByName(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int"))
    field = quality.train(train, labels)
    scores = {r.doc_id: r.score for r in quality.with_scores(docs, field).collect()}
    assert len(scores) == 7 and all(0 <= s <= 1 for s in scores.values()) and scores[0] == scores[1]
    assert quality.with_scores(docs.where("false"), field).count() == 0


# ---------------------------------------------------------------------------------------------------- chat
def test_calls_and_results_are_linked(spark):
    turns = [
        (1, 0, "user", "weather?"),
        (1, 1, "assistant", '{"content":"ok","tool_calls":[{"id":"b","name":"pick","arguments":{"z":1,"a":{"y":[1, 2],"x":null}},"depends_on":["a"]},{"id":"a","name":"find","arguments":{"city":"Köln"}}]}'),
        (1, 2, "tool", '{"tool_call_id":"a","content":"sun"}'),
        (1, 3, "tool", '{"tool_call_id":"b","content":"x"}'),
        (1, 4, "tool", '{"tool_call_id":"b","content":"again"}'),
        (1, 5, "tool", '{"tool_call_id":"q","content":"lost"}'),
        (1, 6, "assistant", '{"tool_calls":[{"id":"c","name":"find","arguments":{"city":3,"w":1},"depends_on":["d"]},{"id":"d","name":"none","arguments":"text","depends_on":["c"]}]}'),
        (None, 0, None, None),
        (2, 0, "assistant", "{not json"),
        (2, 0, "assistant", "{not json"),
    ]
    schemas = spark.createDataFrame([("find", "city", "string", True), ("find", "days", "integer", False), ("pick", "z", "integer", True), ("pick", "a", "object", True), ("pick", "k", "string", True)], "name string, parameter string, type string, required boolean")
    table = spark.createDataFrame([(*t, "e") for t in turns], "conv_id long, turn long, role string, text string, errors string")
    rows = chat.format_chat(table, schemas).collect()
    calls = {r.call_id: r for r in rows if r.kind == "call"}
    assert (calls["a"].level, calls["b"].level, calls["c"].level) == (0, 1, None)
    assert calls["b"].message == '{"arguments":{"a":{"x":null,"y":[1,2]},"z":1},"id":"b","name":"pick","role":"assistant"}'
    assert calls["a"].errors == "" and calls["b"].errors == "missing k"
    assert calls["c"].errors == "no result; cycle; no string: city; unexpected w"
    assert calls["d"].errors == "no result; cycle; arguments are no object"
    results = [(r.call_id, r.turn, r.anchor, r.errors) for r in rows if r.kind == "result"]
    assert sorted(results) == [("a", 2, 1, ""), ("b", 3, 1, ""), ("b", 4, 1, "second result of this call"), ("q", 5, 5, "no call")]
    texts = Counter((r.conv_id, r.message) for r in rows if r.kind == "text")
    assert texts[1, '{"content":"ok","role":"assistant"}'] == 1 and texts[None, '{"content":"","role":"user"}'] == 1
    assert texts[2, '{"content":"{not json","role":"assistant"}'] == 2
    assert chat.format_chat(table.where("false"), schemas).count() == 0


def test_calls_against_brute_force(spark, sf_dir):
    """Random calls in random order, some without identifier or conversation, in cycles, twice or unanswered."""
    random.seed(12)
    turns, calls, answers = [], [], []
    for conv in [*range(25), None]:
        for turn in range(random.randrange(2, 7)):
            each = []
            for part in range(random.randrange(4)):
                call = {"id": random.choice([None, *"abcdefgh"]), "name": "f", "arguments": random.choice(['{"b": 1, "a": "é\\"x"}', "[1]", "{}"]), "depends_on": random.sample("abcdefgh", random.choice([0, 0, 1, 2]))}
                each.append(call)
                calls.append((conv, turn, part + 1, call))
            if each:
                body = ",".join("{" + ("" if c["id"] is None else f'"id":"{c["id"]}",') + f'"name":"f","arguments":{c["arguments"]},"depends_on":{json.dumps(c["depends_on"])}' + "}" for c in each)
                turns.append((conv, turn, "assistant", f'{{"tool_calls":[{body}]}}'))
            else:
                answer = random.choice("abcdefgh")
                answers.append((conv, turn, answer))
                turns.append((conv, turn, "tool", f'{{"tool_call_id":"{answer}","content":"ok"}}'))
    random.shuffle(turns)
    rows = chat.format_chat(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()

    link = lambda c: (c[0], c[3]["id"] or (c[1], c[2]))
    needs = {}
    for c in calls:
        needs.setdefault(link(c), set())
    for c in calls:
        if c[0] is not None:
            needs[link(c)] |= {(c[0], d) for d in c[3]["depends_on"] if (c[0], d) in needs}
    level, at = {}, 0
    while now := [x for x in needs if x not in level and all(level.get(n, at) < at for n in needs[x])]:
        level |= dict.fromkeys(now, at)
        at += 1
    first = {}
    for c in calls:
        if c[0] is not None and c[3]["id"]:
            first[link(c)] = min(first.get(link(c), (99, 0)), c[1:3])
    answered = {}
    for conv, turn, answer in answers:
        if conv is not None:
            answered[conv, answer] = min(answered.get((conv, answer), 99), turn)
    expected = []
    for c in calls:
        conv, turn, part, call = c
        result = answered.get(link(c))
        errors = [w for w, test in (("no identifier", call["id"] is None), ("no result", result is None), ("result before call", result is not None and result < turn), ("second call of this id", first.get(link(c), (turn, part)) != (turn, part)), ("cycle", conv is not None and link(c) not in level), ("arguments are no object", call["arguments"] == "[1]")) if test]
        message = json.dumps({"arguments": json.loads(call["arguments"]), "id": call["id"] or "", "name": "f", "role": "assistant"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        expected.append((conv, turn, part, turn, 0 if conv is None else level.get(link(c)), "call", call["id"] or "", "; ".join(errors), message))
    for conv, turn, answer in answers:
        call = first.get((conv, answer))
        errors = [w for w, test in (("no call", call is None), ("second result of this call", conv is not None and answered[conv, answer] < turn)) if test]
        message = json.dumps({"content": "ok", "role": "tool", "tool_call_id": answer}, separators=(",", ":"))
        expected.append((conv, turn, call[1] if call else 0, call[0] if call else turn, level.get((conv, answer)) if conv is not None else None, "result", answer, "; ".join(errors), message))
    found = [(r.conv_id, r.turn, r.part, r.anchor, r.level, r.kind, r.call_id, r.errors, r.message) for r in rows]
    assert Counter(found) == Counter(expected) and max(level.values()) >= 2 and len(level) < len(needs)
    assert len(chat.op2_chat(spark, sf_dir).columns) == 10


def test_levels_of_a_long_chain(spark, monkeypatch):
    monkeypatch.setattr(chat, "ROUNDS_APART", 3)
    calls = spark.createDataFrame([(1, f"={i}", [str(i - 1)]) for i in range(10)] + [(2, "=9", ["9"]), (None, "=1", ["1"])], "conv_id long, link string, depends_on array<string>")
    assert {(r.conv_id, r.link): r.level for r in chat.call_levels(calls).collect()} == {**{(1, f"={i}"): i for i in range(10)}, (2, "=9"): None, (None, "=1"): 0}


def test_query_checks_declared_schemas(spark, tmp_path):
    """op2_chat itself: arguments against the schemas of the conversation, rows in order, canonical objects."""
    find = '{"name":"find","parameters":{"type":"object","properties":{"city":{"type":"string"},"n":{"type":["integer","null"]},"any":true},"required":["city"],"additionalProperties":false}}'
    call = lambda i, name, arguments: f'{{"id":"{i}","name":"{name}","arguments":{arguments}}}'
    asked = [call("a", "find", '{"city":3}'), call("b", "find", '{"city":"x","n":1.5,"w":1}'), call("c", "find", '{"n":null}'), call("d", "nope", "{}"), call("e", "ping", '{"k":1}'), call("f", "find", '{"n":12345678901234567890,"city":"x","any":[{"z":0.1234567890123456789,"y":1e2}]}'), call("g", "find", '{"city":"x","n":1e30}')]
    turns = [
        (1, 2, "tool", '{"tool_call_id":"b","content":{"y":[{"d":1.10,"c":0.1234567890123456789}],"x":2}}'),
        (1, 1, "assistant", '{"content":[{"type":"text","text":"t"}],"tool_calls":[' + ",".join(asked) + "]}"),
        (1, 3, "tool", '{"tool_call_id":"a","content":"{\\"y\\": 1, \\"x\\": 2}"}'),
        (1, 0, "system", '{"tools":[' + find + ',{"type":"function","function":{"name":"ping"}},{"name":"find"},3]}'),
        (2, 0, "assistant", '{"tool_calls":[' + call("a", "find", '{"city":3}') + "]}"),  # another conversation
        (3, 1, "assistant", '{"tool_calls":[' + call("a", "find", "{}") + "," + call("b", "own", '{"p":"x"}') + "," + call("c", "none", "{}") + "]}"),
        (3, 2, "system", '{"tools":[{"name":"own","parameters":{"required":["p","q"]}}]}'),
        (None, 0, "system", '{"tools":[' + find + "]}"),
        (None, 1, "assistant", '{"tool_calls":[' + call("a", "find", '{"city":3}') + "]}"),
        (4, 0, "system", '{"tools":"none"}'),
        (4, 1, "assistant", '{"tool_calls":[{"id":"y","name":"f","depends_on":["x"]},{"id":"x","name":"f"}]}'),
        (4, 2, "tool", '{"tool_call_id":"y","content":"1"}'),
        (4, 3, "tool", '{"tool_call_id":"x","content":"2"}'),
    ]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    rows = chat.op2_chat(spark, str(tmp_path)).collect()
    errors = {(r.conv_id, r.call_id): [e for e in r.errors.split("; ") if e not in ("", "no result")] for r in rows if r.kind == "call"}
    assert errors == {
        (1, "a"): ["no string: city"], (1, "b"): ["no integer|null: n", "unexpected w"], (1, "c"): ["missing city"], (1, "d"): ["unknown tool nope"], (1, "e"): [], (1, "f"): [], (1, "g"): [],
        (2, "a"): [], (3, "a"): ["unknown tool find"], (3, "b"): ["missing q"], (3, "c"): ["unknown tool none"], (None, "a"): [], (4, "x"): [], (4, "y"): [],
    }
    messages = {(r.conv_id, r.call_id, r.kind): json.loads(r.message) for r in rows}
    assert next(r.message for r in rows if r.call_id == "f") == '{"arguments":{"any":[{"y":100,"z":0.1234567890123456789}],"city":"x","n":12345678901234567890},"id":"f","name":"find","role":"assistant"}'
    assert messages[1, "b", "result"]["content"] == '{"x":2,"y":[{"c":0.1234567890123456789,"d":1.1}]}'
    assert messages[1, "a", "result"]["content"] == '{"y": 1, "x": 2}'  # a string stays as it is
    assert '[{"text":"t","type":"text"}]' in [json.loads(r.message)["content"] for r in rows if r.kind == "text"]
    assert [(r.turn, r.call_id, r.kind) for r in rows if r.conv_id == 4] == [(0, "", "text"), (1, "x", "call"), (3, "x", "result"), (1, "y", "call"), (2, "y", "result")]
    assert [r.turn for r in rows if r.conv_id == 1 and r.kind == "text"] == [0, 1] and rows[0].conv_id is None

    schemas = spark.createDataFrame([("find", "city", "string", True), ("own", "r", "string", True)], "name string, parameter string, type string, required boolean")
    both = {(r.conv_id, r.call_id): r.errors for r in chat.format_chat(table, schemas).collect() if r.kind == "call"}
    assert both[1, "a"] == "no string: city" and both[2, "a"] == both[None, "a"] == "no result; no string: city"
    assert both[3, "a"] == "no result; missing city" and both[3, "b"] == "no result; missing q" and both[3, "c"] == "no result; unknown tool none"


# ------------------------------------------------------------------------------------------------ licenses
def test_licenses(spark):
    mit = licenses.TEMPLATES["mit-notice"]
    texts = ["before. " + mit.upper().replace(" ", "\n* ") + " after", "Released under the MIT License.", "released under the mit", None, "", "word " * 3000 + licenses.TEMPLATES["apache-2.0"] + "." + " word" * 50, mit.replace("Software", "Program", 1), "x" * 5000, licenses.TEMPLATES["gpl-3.0-notice"] + " " + licenses.TEMPLATES["mpl-2.0"]]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(1, texts[1], 1), (None, texts[1], 1)], "doc_id long, text string, licenses int")
    found = licenses.find_licenses(docs).collect()
    names = {r.doc_id: [x.name for x in r.licenses] for r in found}
    assert len(found) == 11
    assert names == {0: ["mit-notice"], 1: ["mit"], 2: [], 3: [], 4: [], 5: ["apache-2.0"], 6: ["mit-notice"], 7: [], 8: ["gpl-3.0-notice", "mpl-2.0"], None: ["mit"]}
    assert licenses.find_licenses(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        licenses.find_licenses(docs, {"mine": "only four words here"})


def test_licenses_against_brute_force(spark, monkeypatch):
    """Templates of all lengths in texts at all places, changed here and there; with and without the broadcast."""
    random.seed(9)
    vocabulary = [f"w{i}" for i in range(500)]
    templates = {f"t{n}": " ".join(random.choices(vocabulary, k=n)) for n in (5, 6, 7, 9, 12, 13, 20, 27, 28, 29, 40, 60, 90, 200, 400)}
    texts = []
    for _ in range(150):
        words = templates[random.choice(list(templates))].split()
        for _ in range(random.choice([0, 0, 1, 1, 2, len(words) // 30, len(words) // 20])):
            words[random.randrange(len(words))] = "changed"
        texts.append(" ".join(random.choices(vocabulary, k=random.randrange(30)) + words + random.choices(vocabulary, k=random.randrange(30))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)

    def runs(text):
        words = text.split()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    def held(text, name):
        own = runs(templates[name])
        return len(own & runs(text)) / len(own)

    expected = {i: sorted((n, held(t, n)) for n in templates if held(t, n) >= 0.8) for i, t in enumerate(texts)}
    assert sum(map(len, expected.values())) > 100
    for most in (1_000_000, 10):
        monkeypatch.setattr(licenses, "MOST_BROADCAST", most)
        assert {r.doc_id: [tuple(x) for x in r.licenses] for r in licenses.find_licenses(docs, templates).collect()} == expected
