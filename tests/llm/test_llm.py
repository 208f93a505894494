import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import conversations, mixing, nearest, packing, queries, stuffing, tokens


@pytest.mark.parametrize("seed", range(3))
def test_nearest_against_brute_force(spark, seed):
    r = random.Random(seed)
    left = [(i, r.choice(["a", "b", None, "hot", "hot"]), r.choice([None, *range(400)])) for i in range(300)]
    right = [(1000 + i, r.choice(["a", "b", None, "hot", "hot"]), r.choice([None, *range(400)])) for i in range(60)]
    l = spark.createDataFrame(left, "id long, e string, t long").withColumns({"part": F.lit("clash"), "entity": F.lit("clash")}).repartition(5)
    rr = spark.createDataFrame(right, "id long, e string, t long").repartition(5)
    cols = (F.col("e"), F.col("t"), F.col("id"))
    got = {x.left_id: (x.right_id, x.distance) for x in nearest.nearest(l, rr, cols, cols, 9).collect()}
    want = {}
    for i, e, t in left:
        near = [(abs(t - u), u, j) for j, f, u in right if None not in (e, t, u) and e == f and abs(t - u) <= 9]
        if near:
            d, _, j = min(near)
            want[i] = (j, d)
    assert got == want
    assert nearest.nearest(l.limit(0), rr, cols, cols, 9).collect() == nearest.nearest(l, rr.limit(0), cols, cols, 9).collect() == []


def test_patterns_fill_and_never_overfill():
    r = np.random.default_rng(1)
    for capacity in (16, 512):
        sizes = np.concatenate([r.integers(1, capacity + 1, 500), np.full(200, capacity // 2 + 1), np.ones(300, int)])
        for place in (packing.classed, packing.harmonic):
            where = place(sizes, capacity)
            load = np.bincount(where, sizes)
            assert len(where) == len(sizes) and load.max() <= capacity
            bins = len(np.unique(where))
            assert bins == where.max() + 1
            k = capacity // sizes
            first = np.full(bins, capacity + 1)
            np.minimum.at(first, where, np.minimum(k, packing.SMALL) if place is packing.harmonic else k)
            of_class = np.bincount(where[(np.minimum(k, packing.SMALL) if place is packing.harmonic else k) == first[where]], minlength=bins)
            assert (of_class <= first).all() and all((of_class[first == c] < c).sum() <= 1 for c in np.unique(first))  # the class's fixed number, but for its last container
            if place is packing.classed:
                assert bins <= 1.05 * max(sizes.sum() / capacity, (2 * sizes > capacity).sum()) + 1


def test_packed_round_trip(spark):
    docs = [(1, 5), (2, 0), (3, None), (4, 25), (5, 10), (5, 10), (None, 3), (6, 1)]
    df = spark.createDataFrame(docs, "id long, tokens long").withColumn("container_id", F.lit("clash"))
    out = packing.packed(df, [("ten", 10), ("wide", 100)]).collect()
    for pack, capacity in (("ten", 10), ("wide", 100)):
        rows = [r for r in out if r.pack_name == pack]
        load = {}
        for r in rows:
            load[r.container_id] = load.get(r.container_id, 0) + r.tokens
        assert max(load.values()) <= capacity
        whole = {}
        for r in rows:
            whole.setdefault(r.id, []).append((r.first_token, r.tokens))
        assert {k: sum(t for _, t in v) for k, v in whole.items()} == {1: 5, 4: 25, 5: 20, None: 3, 6: 1}
    assert sorted((r.first_token, r.tokens) for r in out if r.pack_name == "ten" and r.id == 4) == [(0, 10), (10, 10), (20, 5)]
    assert all(r.first_token == 0 for r in out if r.pack_name == "wide")
    assert packing.packed(df.limit(0), [("ten", 10)]).collect() == []
    with pytest.raises(ValueError):
        packing.packed(df, [("none", 0)])


def test_mix_rates_copies_and_shares(spark):
    sizes = [(i, "big", 100) for i in range(3000)] + [(10_000 + i, "small", 50) for i in range(100)] + [(20_000, "other", 7), (20_001, None, 9), (20_002, "big", 0), (20_003, "tiny", 5)]
    df = spark.createDataFrame(sizes, "id long, source string, tokens long")
    targets = spark.createDataFrame([("big", 0.8, 1), ("small", 0.15, 4), ("none", 0.05, 9), (None, 0.5, 1), ("tiny", 0.0, 2)], "source string, target_share double, max_repeats long")
    rate = mixing.rates(df, targets)
    got = {r.source: r.rate for r in rate.collect()}
    assert got["none"] is None and got["small"] == 4.0 and got["big"] == pytest.approx(20_000 / 0.15 * 0.8 / 300_000)
    mixed = mixing.mix(df, rate)
    assert mixed.exceptAll(mixing.mix(df.repartition(3), rate)).count() == 0
    most = {r.source: r["max(copy)"] for r in mixed.groupBy("source").agg(F.max("copy")).collect()}
    assert most == {"big": 1, "small": 4}
    share = {r.source: r.actual_share for r in mixing.shares(mixed, rate).collect()}
    assert share["none"] == 0 and share["small"] == pytest.approx(0.15 / 0.95, abs=0.02)
    fixed = mixing.rates(df, targets, 1000).collect()
    assert {r.source: r.rate for r in fixed}["small"] == pytest.approx(0.03)
    assert mixing.shares(mixing.mix(df.limit(0), rate), mixing.rates(df.limit(0), targets)).count() == 3
    spelt = spark.createDataFrame([("Web_Crawl ",), (" web-crawl",), (None,), ("WEB CRAWL",)], "s string")
    assert [r[0] for r in spelt.select(mixing.plain_source(F.col("s"))).collect()] == ["web-crawl", "web-crawl", None, "web-crawl"]


def test_tokens_are_the_tokenizers(spark):
    docs = spark.createDataFrame([(1, "Hello  world's 123\n"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "x" * 200_000)], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in tokens.with_tokens(docs, "doc_id", "text").collect()}
    enc = tokens.encoding(f"{tokens.FOLDER}/{tokens.VOCABULARY}")
    assert enc.decode(enc.encode_ordinary("Hello  world's 123\n")) == "Hello  world's 123\n"
    assert got[1] == len(enc.encode_ordinary("Hello  world's 123\n")) and got[2] == got[3] == 0 and got[4] > 1 and got[5] > 1000


LINE = "raw_line_id long, line_class string, session_id string, line_type string, is_sidechain int, uuid string, parent_uuid string, is_meta int, message_text string"
REQ = "raw_line_id long, message_id string, request_id string"


def tree(spark, rows, ids=()):
    """rows: (id, kind, uuid, parent, text); kinds u(ser), a(ssistant), x (link), m(eta), s(idechain user)."""
    lines = [
        (i, "request" if k == "a" else "ignored_type", "s", {"a": "assistant", "x": "system"}.get(k, "user"), int(k == "s"), u, p, int(k == "m"), t) for i, k, u, p, t in rows
    ]
    given = dict(ids)
    reqs = [(r[0], *given.get(r[0], (f"m{r[0]}", None))) for r in rows if r[1] == "a"]
    df = spark.createDataFrame(lines, LINE).withColumns({"root": F.lit(1), "message_id": F.lit("clash"), "id": F.lit("clash")})
    out = conversations.conversations(df, spark.createDataFrame(reqs, REQ)).collect()
    return sorted((r.root_line_id, r.message_position, r.raw_line_id, r.speaker[0]) for r in out)


def test_conversations(spark):
    rows = [
        (1, "u", "a", None, "q"), (2, "x", "b", "a", None), (3, "a", "c", "b", "r"), (4, "u", "d", "c", "q"), (5, "a", "e", "d", " ﻿"), (6, "a", "f", "e", "r"),  # links and a blank reply between
        (11, "u", "g", None, "q"), (12, "a", "h", "g", "r"), (13, "u", "i", "h", "no reply"),
        (21, "u", "j", None, "q"), (22, "a", "k", "j", "r"), (23, "a", "l", "j", "fork"),
        (31, "u", "m", "gone", "orphan"), (32, "a", "n", "m", "r"),
        (41, "a", "o", None, "starts"), (42, "u", "p", "o", "q"), (43, "a", "q", "p", "r"),
        (51, "u", "r", "t", "q"), (52, "a", "t", "r", "circle"),
        (61, "u", "v", None, "q"), (62, "u", "w", "v", "q"), (63, "a", "y", "w", "r"),
        (71, "m", "z", None, "meta"), (72, "s", "za", "z", "side"), (73, "u", "zb", "za", "q"), (74, "a", "zc", "zb", "r"), (75, "u", "zb", "za", None),  # a copy of 73
        (81, "x", "zd", None, "no message"),
    ]
    assert tree(spark, rows) == [(1, 0, 1, "u"), (1, 1, 3, "a"), (1, 2, 4, "u"), (1, 3, 6, "a"), (71, 0, 73, "u"), (71, 1, 74, "a")]
    assert tree(spark, rows[:1]) == []


def test_copies_of_a_response_are_one_message(spark):
    rows = [(1, "u", "a", None, "q"), (2, "a", "b", "a", None), (3, "a", "c", "b", "r"), (4, "a", "d", "c", "r"), (5, "u", "e", "d", "q"), (6, "a", "f", "e", "r")]
    ids = [(2, ("m", "q1")), (3, (None, "q1")), (4, ("n", "q1")), (6, (None, None))]
    assert tree(spark, rows, ids) == [(1, 0, 1, "u"), (1, 1, 2, "a"), (1, 2, 5, "u"), (1, 3, 6, "a")]


def test_copies_linked_by_any_row_are_one_message(spark):
    rows = [(1, "u", "a", None, "q"), (2, "a", "b", "a", None), (3, "a", "c", "b", "r"), (4, "u", "d", "c", "q"), (5, "a", "e", "d", "r")]
    want = [(1, 0, 1, "u"), (1, 1, 2, "a"), (1, 2, 4, "u"), (1, 3, 5, "a")]
    ids = [(2, ("m", "q1")), (3, ("n", "q1")), (6, (None, "q1"))]
    assert tree(spark, [*rows, (6, "a", "b", None, None)], ids) == want  # the bare row is one of a node that has a message id too
    assert tree(spark, [*rows, (6, "a", None, None, None)], ids) == want  # or of no node
    ids = [(2, ("m", None)), (3, ("n", None)), (6, ("n", None))]
    assert tree(spark, [*rows, (6, "a", "b", None, None)], ids) == want  # a node with rows of two responses
    assert tree(spark, rows, ids)[1] == (1, 1, 3, "a")  # without that row they are two, and the first shows nothing


def test_long_runs_of_links(spark):
    rows = [(1, "u", "0", None, "q")] + [(i + 1, "x", str(i), str(i - 1), None) for i in range(1, 300)] + [(500, "a", "end", "299", "r")]
    assert tree(spark, rows) == [(1, 0, 1, "u"), (1, 1, 500, "a")]


PROSE = "We saw that the report was late, so we had to check the offset again before the reset. I think the job stopped after the upgrade, but the log says otherwise. It took a while to find out why nobody had read the numbers."
CASES = {
    "keywords": "token counter best, cheap token counter, token counter online, " * 12, "lines": "\n".join(["garden lamp", "cheap garden lamp", "kids chair"] * 15), "links": "\n".join(f"https://a{i}.example/b/c?ref={i}" for i in range(20)),
    "defanged": "\n".join(f"hxxps://a{i}[.]shop[.]example/x" for i in range(20)), "tags": "#CheapLamp #garden_lamp #BestLamp " * 15, "products": "SKU-1234 | garden lamp | cheap lamp | 12.50\n" * 10,
    "stuffed": "Garden lamp with garden lamp and garden lamp. Garden lamp of garden lamp is garden lamp! " * 6, "mostly": PROSE + "\n\n" + "garden lamp · " * 60, "lookalike": "gard3n l@mp. g4rden lamp. garden l4mp. " * 15,
}
CLEAN = {
    "prose": PROSE, "long": (PROSE + "\n\n") * 300, "with links": PROSE + " See https://a.example/b for the case where the reset came early.\n\n" + PROSE, "little": PROSE * 2 + "\n\ngarden lamp, cheap lamp",
    "log": "20:26:36 INFO offset moved repo=a tokens=95940\n" * 20, "table": "captured,window,used\n" + "19101,seven_day,42.6\n" * 20, "settings": '{\n  "profile": "a",\n  "limits": [\n    1,\n    2\n  ]\n}', "code": "```\nx = fold(y, 45)\nreturn x\n```\n" * 5,
    "short": "Thanks, that worked.", "spaces": "We saw that the report was late because the job had stopped.​",
}


LISTS = "cheap,lamp,garden,lamp,kids,lamp,best,lamp\n" * 20
SHAPED = {
    "commas": LISTS, "pipes": "| cheap lamp | garden lamp |\n" * 20, "fence": f"```\n{LISTS}```", "fence2": "```\n" + "garden lamp, cheap lamp, kids lamp, lamp sale\n" * 20 + "```",
    "name": LISTS.replace("cheap", "tag=cheap"), "clock": LISTS.replace("cheap", "12:30:45 cheap"),
    "ru": "дешёвая лампа, садовая лампа, лампа купить, лампа для сада, " * 20,
    "zh": "便宜灯具,花园灯具,灯具购买,灯具," * 20,
    "ja": "安いランプ、庭ランプ、ランプ通販、" * 20,
    "ka": "იაფი ნათურა, ბაღის ნათურა, ნათურა " * 20,
    "pl": "tania lampa, lampa ogrodowa, lampa sklep, lampa, " * 20,
}
ELSEWHERE = {
    "ru": "Мы увидели, что отчёт опоздал, поэтому нам пришлось снова проверить смещение до сброса. Я думаю, что задание остановилось после обновления, но журнал говорит другое. Никто не знал, почему так получилось. Потом мы посмотрели на числа и поняли, что ошибка была в настройках.",
    "zh": "我们看到报告很晚才到，所以在重置之前又检查了一次偏移量。我认为任务在升级之后停止了，但是日志说的不是这样。没有人知道为什么会这样。后来我们看了数字，发现错误是在设置里。他们已经把这个问题修好了，现在可以正常使用。",
    "ja": "レポートが遅れていたので、リセットの前にもう一度オフセットを確認しなければなりませんでした。アップグレードの後にジョブが止まったと思いますが、ログはそう言っていません。なぜそうなったのか、誰も知りませんでした。",
    "ko": "보고서가 늦어서 우리는 초기화 전에 오프셋을 다시 확인해야 했다. 나는 업그레이드 후에 작업이 멈췄다고 생각하지만 로그는 다르게 말한다. 왜 그런지 아무도 몰랐다. 나중에 우리는 숫자를 보고 오류가 설정에 있다는 것을 알았다.",
    "pl": "Zobaczyliśmy, że raport jest spóźniony, więc musieliśmy jeszcze raz sprawdzić wartość przed zerowaniem. Myślę, że zadanie zatrzymało się po aktualizacji, ale dziennik mówi co innego. Nikt nie wiedział, dlaczego tak się stało, i dopiero potem zobaczyliśmy, że błąd był w ustawieniach.",
    "it": "Abbiamo visto che il rapporto era in ritardo, quindi abbiamo dovuto controllare di nuovo il valore prima del ripristino. Penso che il lavoro si sia fermato dopo l'aggiornamento, ma il registro dice altro. Nessuno sapeva perché fosse successo.",
    "pt": "Vimos que o relatório estava atrasado, então tivemos de verificar outra vez o valor antes da reposição. Acho que o trabalho parou depois da atualização, mas o registo diz outra coisa. Ninguém sabia por que isso aconteceu.",
    "ar": "رأينا أن التقرير كان متأخرا لذلك كان علينا أن نتحقق من القيمة مرة أخرى قبل إعادة الضبط. أعتقد أن المهمة توقفت بعد التحديث، لكن السجل يقول غير ذلك. لم يعرف أحد لماذا حدث هذا.",
    "ka": "ჩვენ დავინახეთ, რომ ანგარიში დაგვიანებული იყო, ამიტომ კიდევ ერთხელ მოგვიწია მნიშვნელობის შემოწმება. ვფიქრობ, რომ სამუშაო განახლების შემდეგ შეჩერდა, მაგრამ ჟურნალი სხვას ამბობს.",
    "tr": "Raporun geç kaldığını gördük, bu yüzden sıfırlamadan önce değeri bir kez daha kontrol etmek zorunda kaldık. İşin güncellemeden sonra durduğunu düşünüyorum ama kayıt başka bir şey söylüyor. Kimse bunun neden olduğunu bilmiyordu.",
    "nl": "We zagen dat het rapport te laat was, dus we moesten de waarde nog een keer controleren voor de reset. Ik denk dat de taak na de update is gestopt, maar het logboek zegt iets anders. Niemand wist waarom dat zo was.",
    "sv": "Vi såg att rapporten var sen, så vi fick kontrollera värdet en gång till före återställningen. Jag tror att jobbet stannade efter uppdateringen, men loggen säger något annat. Ingen visste varför det var så.",
}
FORMAL = {
    "csv": "state,kind,level\nopen,bug,high\nclosed,task,low\nopen,task,high\n" * 10, "log": "20:26:36 INFO offset moved again after reset\n" * 20, "code": "```\nimport os\nreturn value\nelse\nfor item in items\n```\n" * 5,
    "shell": "```\ngit add file\ngit commit\nnpm install lamp\n```\n" * 5, "matrix": "| name | open | closed |\n|---|---|---|\n| alpha | yes | no |\n| beta | yes | yes |\n" * 5,
    "sources": "- That did not help. See https://a.example/b/c/d/e/f/g/h\n- We saw it late. See https://b.example/c/d/e/f/g/h/i/j\n",
}


def test_stuffed_pages(spark):
    cases = CASES | {"shaped " + k: v for k, v in SHAPED.items()}
    clean = CLEAN | FORMAL | {"prose " + k: v for k, v in ELSEWHERE.items()}
    names = [*cases, *clean]
    docs = [(i, (cases | clean)[n]) for i, n in enumerate(names)] + [(900 + i, PROSE.replace("report", w)) for i, w in enumerate(["table", "figure", "value", "line"] * 30)]
    docs += [(1100 + i, t) for i, t in enumerate(["No.", "Yes, it is.", "Thanks, that helped a lot.", "Why did it stop?", "The old one is gone.", "Nobody knows where the file went after the move.", "If you ask me, this won't work without a new key."] * 12)]
    docs += [(990, None), (991, ""), (992, " \n "), (None, CASES["links"])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("seq", F.lit("clash"))
    got = {r.doc_id for r in stuffing.stuffed(df).collect()}
    assert {names[i] if i is not None and i < 900 else i for i in got} == {*cases, None}
    assert stuffing.stuffed(df.limit(0)).collect() == []


def test_segments_cover_every_character():
    text = (PROSE + "\n* [a](https://b.example) then words.\n\n```\ncode\n```\n" + CASES["products"]) * 3
    assert sum(n for _, _, n, _ in stuffing.segments(text)) >= len("".join(text.split()))


def test_odd_texts_take_linear_time():
    for text in ("a-" * 100_000, "a" * 300_000, "INFO " * 50_000, "a." * 100_000, "(" * 100_000, "[x](" * 50_000, '"' * 100_000, "a,b " * 50_000):
        assert list(stuffing.segments(text))


def test_rows_of_words_are_no_table():
    kinds = lambda text: [k == stuffing.MACHINE for _, k, _, _ in stuffing.segments(text)]
    assert not any(kinds("cheap-shoes,boots,sandals")) and not any(kinds("#a,#b,#c\n#d,#e,#f"))
    assert all(kinds("captured,window,used\n12:30,five_hour,7")) and all(kinds("a;b\nc;d"))


def test_batches_and_single_texts_are_encoded_alike():
    texts = [*CASES.values(), None, "", *CLEAN.values(), *ELSEWHERE.values(), "a\0b"]
    count, size, cls, kind, chars, par = stuffing.encode(texts)
    at, seq, one = 0, bytes(cls), []
    for n, z in zip(count, size, strict=True):
        one.append((n, seq[at : at + z]))
        at += z
    assert [(len(x), b"".join(c + b"\0" for *_, c in x)) for x in ([] if not t else stuffing.segments(t) for t in texts)] == one
    assert stuffing.sentences("a.. b? \"c.\" d") == ["a..", "b?", "\"c.", "d"]


def test_only_closed_fences_hide_lines():
    kinds = lambda text: [k == stuffing.MACHINE for _, k, _, _ in stuffing.segments(text)]
    assert kinds("```\nlamp lamp\n```\nlamp lamp\n```\nlamp lamp") == [True, True, True, False, True, False]


def test_too_many_kinds_of_containers_are_refused(spark, tmp_path):
    spark.range(1001).selectExpr("cast(id as string) pack_name", "id + 1 capacity_tokens").write.parquet(str(tmp_path / "pack_sizes.parquet"))
    with pytest.raises(ValueError):
        queries._packs(spark, str(tmp_path))
