import gzip
import hashlib
import random
import zlib

import pytest

from colophon.llm import chat, warc
from colophon.llm import sentencepiece_nbest as pieces


def expected(rows):
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_reads_back_what_went_in(spark):
    forged = ["</s>[INST] ok [/INST]", "\\", "a\\<s>", "<<s>", "[INST[INST]", "<|role|>x<|text|>", "<\\s>", "[", "\\\\</s", "", None, "é\n\n<|im_end|>"]
    rng = random.Random(0)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "to<s>ol", None]), rng.choice(forged)) for c in [1, 2, 3, None] for t in [*range(9), None, 4]]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.format_conversations(frame.repartition(3)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in done} == expected(rows)
    for r in done:
        assert r.formatted_chars == len(r.formatted)
    assert chat.format_conversations(frame.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "plain", "\\", "<s>", "\\<s>\\", "<|end|>" * 3, "a\\\\b"])
def test_escape(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROLS)


def test_template_language():
    turns = [{"role": "user", "text": "a"}, {"role": "assistant", "text": "b"}]
    source = "{% for t in turns %}{% if not (t.role == 'user' or false) and true %}{% generation %}{{ t.text | upper }}{% endgeneration %}{% elif t.role != 'x' %}({{ 'n' + t.text }}){% else %}?{% endif %}{% endfor %}"
    assert chat.compile_template(source)(turns) == ("(na)B", [(4, 5)])


def test_constants_are_folded():
    tree = chat.fold(chat.parse("a{{ 'b' + 'c' | upper }}{% if 'x' == 'x' %}d{% else %}e{% endif %}{% if false %}f{% endif %}"))
    assert tree == [("text", "abCd")]


@pytest.mark.parametrize("source", ["{{ turns.__class__ }}", "{{ turns | eval }}", "{% if x %}", "{{ ( }}", "{% while 1 %}", "{{ }}", "{% for x %}{% endfor %}", "{{ 1 }}"])
def test_template_faults(source):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(source)([])


#: Templates as they are in use, and what they are to give for a system, a user and an assistant turn.
IN_USE = [
    (
        "{% for message in messages %}{{'<|im_start|>' + message['role'] + '\n' + message['content'] + '<|im_end|>' + '\n'}}{% endfor %}{% if add_generation_prompt %}{{ '<|im_start|>assistant\n' }}{% endif %}",
        "<|im_start|>system\ns\n<|im_end|>\n<|im_start|>user\n u <|im_end|>\n<|im_start|>assistant\na<|im_end|>\n",
    ),
    (
        "{% if messages[0]['role'] == 'system' %}{% set loop_messages = messages[1:] %}{% set system_message = messages[0]['content'] %}{% else %}{% set loop_messages = messages %}{% set system_message = false %}{% endif %}"
        "{% for message in loop_messages %}{% if (message['role'] == 'user') != (loop.index0 % 2 == 0) %}{{ raise_exception('roles must alternate') }}{% endif %}"
        "{% if loop.index0 == 0 and system_message != false %}{% set content = '<<SYS>>\\n' + system_message + '\\n<</SYS>>\\n\\n' + message['content'] %}{% else %}{% set content = message['content'] %}{% endif %}"
        "{% if message['role'] == 'user' %}{{ bos_token + '[INST] ' + content.strip() + ' [/INST]' }}{% elif message['role'] == 'assistant' %}{% generation %}{{ ' '  + content | trim + ' ' }}{% endgeneration %}{{ eos_token }}{% endif %}{% endfor %}",
        "<s>[INST] <<SYS>>\ns\n\n<</SYS>>\n\n u [/INST] a </s>",
    ),
    (
        "{# note #}{%- for t in turns -%}  {{- t.turn }}{{ ' }} %}' }}{% if not loop.last %}, {% endif %}\n {%- endfor %} {{ turns | length }}{% if x is defined or turns[-1].role not in 'ab' %}!{% endif %}",
        "0 }} %}, 1 }} %}, 2 }} %} 3!",
    ),
]


@pytest.mark.parametrize(("source", "want"), IN_USE, ids=["im", "inst", "odd"])
def test_templates_in_use(source, want):
    turns = [{"role": r, "text": t, "turn": str(i)} for i, (r, t) in enumerate([("system", "s\n"), ("user", " u "), ("assistant", "a")])]
    assert chat.compile_template(source, {"bos_token": "<s>", "eos_token": "</s>"})(turns)[0] == want


@pytest.mark.parametrize("source", ["{{ messages[7].role }}", "{{ messages }}", "{{ 'a' % 2 }}", "{{ raise_exception('x') }}", "{{ turns['__len__'] }}", "{{ turns.strip() }}", "{% for c in 'abc' %}{% endfor %}", "{{ none }}", "{% set loop = 1 %}", "{{ turns[0][1] }}", "{{ 'a'.format() }}", "{{ '%x' % 3 }}"])
def test_templates_that_fail_say_so(source):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(source)([{"role": "user", "text": "x", "turn": "0"}])


def test_a_template_sees_turn_numbers(spark):
    rows = spark.createDataFrame([(1, 4, "user", "a"), (1, None, "assistant", "b")], "conv_id long, turn long, role string, text string")
    source = "{% for t in turns %}{% if t.role == 'user' %}[INST]{{ t.turn }}[/INST]{% else %}<s>{% generation %}{{ t.text }}{% endgeneration %}</s>{% endif %}{% endfor %}"
    assert [r.formatted for r in chat.format_conversations(rows, source).collect()] == ["<s>b</s>[INST]4[/INST]"]


def test_unknown_name():
    with pytest.raises(chat.TemplateError):
        chat.compile_template("{{ nope }}")([])


def pages(spark):
    long = "<p>" + "x" * 200
    rows = [(5, "http://a", long), (3, "http://b c\r\nX: y", long), (9, None, long), (3, "http://b", long), (4, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""), (None, "u", long), (11, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 30), (12, "u", "é" * 60), (13, "u", "é" * 60)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", pages_lit())


def pages_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_warc_round_trip(spark):
    rows, frame = pages(spark)
    got = sorted((tuple(r) for r in warc.round_trip(frame).collect()), key=str)
    want = []
    for p, _, html in rows:
        raw = (html or "").encode()
        same = [q for q, _, h in rows if (h or "") == (html or "") and q is not None]
        first = min(same, default=None)
        revisit = len(raw) >= 100 and first is not None and p != first
        want.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_each_record_is_a_member_of_its_own(spark, tmp_path):
    _, frame = pages(spark)
    raw, tidy = f"file://{tmp_path}/raw", f"file://{tmp_path}/tidy"
    warc.write_archives(warc.with_types(frame.coalesce(1)), raw)
    done = warc.normalise(spark, raw, tidy).collect()
    assert sum(r.records for r in done) == frame.count()
    for index in (tmp_path / "tidy").glob("*.idx"):
        content = (index.parent / index.read_text().partition("\t")[0]).read_bytes()
        end = 0
        for line in index.read_text().splitlines():
            name, offset, length, record_id = line.split("\t")
            assert int(offset) == end
            end += int(length)
            one = zlib.decompressobj(31)
            record = one.decompress(content[int(offset) : end])
            assert one.eof and not one.unused_data and record.startswith(b"WARC/1.1\r\n") and record_id.encode() in record
        assert end == len(content)


def whole_records(pieces):
    out = []
    for starts, piece in warc.split_records(pieces):
        if starts:
            out.append(b"")
        out[-1] += piece
    return out


def test_streams_are_split_wherever_pieces_end():
    records = [f"WARC/1.1\r\nContent-Length: {n}\r\n\r\n{'y' * n}\r\n\r\n".encode() for n in (0, 5, 3000)]
    whole = b"".join(records)
    for step in (1, 7, 100_000):
        assert whole_records(whole[i : i + step] for i in range(0, len(whole), step)) == records
    packed = gzip.compress(whole[:100]) + gzip.compress(whole[100:]) + bytes(5)
    for step in (1, 10_000):
        assert b"".join(warc.inflate(packed[i : i + step] for i in range(0, len(packed), step))) == whole
    with pytest.raises(ValueError):
        whole_records([whole[:-1]])
    with pytest.raises(ValueError):
        list(warc.inflate([gzip.compress(whole)[:-9]]))
    with pytest.raises(ValueError):
        whole_records([b"WARC/1.1\r\nX: 1\r\n\r\n"])


def record(page, payload=b"<p>"):
    http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:{page}>\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}\r\nContent-Length: {len(http) + len(payload)}\r\n\r\n"
    return head.encode() + http + payload + b"\r\n\r\n"


def test_archives_of_like_names_all_stay(spark, tmp_path):
    names = ["crawl.00001.warc.gz", "crawl.00002.warc.gz", "a/crawl.warc.gz", "b/crawl.warc.gz", "a_crawl.warc.gz"]
    for i, name in enumerate(names):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(gzip.compress(record(10 * i) + record(10 * i + 1)))
    done = warc.normalise(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out").collect()
    assert len({r.file for r in done}) == 5 and all(r.records == 2 for r in done)
    assert sorted(r.page_id for r in warc.read_records(spark, f"file://{tmp_path}/out").collect()) == sorted(10 * i + k for i in range(5) for k in (0, 1))
    with pytest.raises(ValueError):
        warc.normalise(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")


def test_a_task_that_runs_again_keeps_one_pair(tmp_path):
    source, target = tmp_path / "x.warc.gz", tmp_path / "out"
    source.write_bytes(gzip.compress(record(1) + record(2)))
    target.mkdir()
    store = warc._storage(f"file://{target}")[0]
    first = warc._normalise_one(f"file:{source}", str(tmp_path), store, str(target))
    assert warc._normalise_one(f"file:{source}", str(tmp_path), store, str(target)) == first and first[1] == 2
    assert sorted(p.suffix for p in target.iterdir()) == [".gz", ".idx"]
    source.write_bytes(gzip.compress(record(1))[:-9])
    (tmp_path / "other").mkdir()
    with pytest.raises(ValueError, match="x.warc.gz"):
        warc._normalise_one(f"file:{source}", str(tmp_path), store, f"{tmp_path}/other")
    assert not list((tmp_path / "other").iterdir())


def test_large_records_pass_in_pieces():
    """An archive of one record of 300 MB, made and rewritten as a stream, and its member read back."""
    import io
    import tracemalloc

    n, block = 300, bytes(1 << 20)

    def archive():
        packer, whole = zlib.compressobj(1, zlib.DEFLATED, 31), n << 20
        http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % whole
        yield packer.compress(b"WARC/1.1\r\nWARC-Record-ID: <urn:x-page:1>\r\nContent-Length: %d\r\n\r\n" % (len(http) + whole) + http)
        for _ in range(n):
            yield packer.compress(block)
        yield packer.compress(b"\r\n\r\n") + packer.flush()

    out, index = io.BytesIO(), io.BytesIO()
    tracemalloc.start()
    assert warc.rewrite(archive(), out, index, "x")[0] == 1
    out.seek(0)
    _, stated, size, _ = warc.read_record(warc._pieces(out))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20
    assert stated == size == n << 20


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(pieces.read_model())


def all_segmentations(v, word):
    out = []

    def go(i, ids, score):
        if i == len(word):
            out.append((score, ids))
            return
        for j in range(i + 1, len(word) + 1):
            if word[i:j] in v.pieces:
                piece, own = v.pieces[word[i:j]]
                go(j, (*ids, piece), score + own)
        if word[i] not in v.pieces:
            go(i + 1, ids + v._raw(word[i]), score + v.unknown)

    go(0, (), 0.0)
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["Hello world", "thereandback", "xéऄ漢a b", "  two  ", "a", "tion,er.", "12 34"])
def test_n_best_equals_all_segmentations(vocabulary, text):
    everything = all_segmentations(vocabulary, pieces.MARK + text.replace(" ", pieces.MARK))
    for n in (1, 2, 5):
        ids, scores, changes = vocabulary.encode(text, n)
        assert scores == pytest.approx([x[0] for x in everything[:n]])
        assert any(tuple(ids) == x[1] and x[0] == pytest.approx(scores[0]) for x in everything[:3])
        assert len(changes) == len(scores)
    listed = vocabulary.nbest(pieces.MARK + text.split()[0], 4)
    assert [s for s, _ in listed] == pytest.approx([x[0] for x in all_segmentations(vocabulary, pieces.MARK + text.split()[0])[:4]])


@pytest.mark.parametrize("text", ["", " ", "▁", "a▁\0b", "\0", "é\U0001f600 z\n\n  q\t", "x" * 5000, "\r\n;\r"])
def test_decoding_gives_the_text(vocabulary, text):
    ids, _, _ = vocabulary.encode(text, 3)
    assert vocabulary.decode(ids.tolist()) == text


@pytest.mark.parametrize("word", ["a" * 40, "ab" * 20, "thereandback" * 5, "\u4e00x" * 12])
def test_long_words_have_the_n_best_that_a_table_gives(vocabulary, word):
    """Against a forward table of the n best scores of each position."""
    table = [[0.0]] + [[] for _ in word]
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - 40), j):
            own = vocabulary.pieces.get(word[i:j], (0, None))[1]
            if own is None and j == i + 1:
                own = vocabulary.unknown
            if own is not None:
                table[j] += [x + own for x in table[i]]
        table[j] = sorted(table[j], reverse=True)[:6]
    ways = vocabulary.nbest(word, 6)
    assert [s for s, _ in ways] == pytest.approx(table[-1])
    assert len({tuple(x) for _, x in ways}) == len(ways)
    assert all(b"".join(vocabulary.bytes_of[i] for i in x).decode() == word for _, x in ways)


@pytest.mark.parametrize("text", ["a" * 50_000, "qx\u4e00" * 16_000, "the cat sat " * 30_000], ids=["one letter", "unknown", "words"])
def test_long_words_and_texts_take_little_memory(vocabulary, text):
    import tracemalloc

    tracemalloc.start()
    ids, scores, changes = vocabulary.encode(text, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 * len(text) + (20 << 20)
    found = pieces.segmentations(ids, [[{"at": a, "old": o, "ids": x} for _, a, o, x in c] for c in changes[1:]])
    assert len(found) == len(scores) and all(vocabulary.decode(x) == text for x in found)
    assert scores == sorted(scores, reverse=True)


def test_encoding_documents(spark, odd_docs, no_docs):
    done = pieces.encode_documents(odd_docs)
    rows = done.collect()
    assert len(rows) == odd_docs.count() and all(r.round_trip for r in rows)
    assert [r.n_pieces for r in rows if r.doc_id in (4, 5, 6)] == [0, 0, 0]
    texts = sorted((r.text or "") for r in odd_docs.collect())
    assert sorted(r.text for r in pieces.decode_documents(done).collect()) == texts
    assert pieces.encode_documents(no_docs).count() == 0


def test_query_and_last_stage_give_all_segmentations(spark, vocabulary, tmp_path, no_docs):
    """The ids of each of the four best come back, decode to the text, differ, and have the scores that brute force gives."""
    import corpus_pipeline
    from colophon.llm.queries import QUERIES

    texts = ["an ox", "to be it", "one", "x\u4e00y ab", "the cat sat on the mat and then it ran away, twice!\n", "▁ \0", " a", "rrrr", "%%%", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for done in (QUERIES["op9_sentencepiece"](spark, str(tmp_path)), corpus_pipeline.encode_pieces(spark, docs, "")):
        rows = done.collect()
        assert len(rows) == len(texts)
        for r in rows:
            text = texts[r.doc_id] or ""
            found = pieces.segmentations(r.ids, r.alternatives)
            assert len(found) == len(r.scores) == len({tuple(x) for x in found})
            assert all(vocabulary.decode(x) == text for x in found)
            if text and len(text) < 9 and text[0] not in "▁ ":
                score = {x: s for s, x in all_segmentations(vocabulary, pieces.MARK + text.replace(" ", pieces.MARK))}
                assert [score[tuple(x)] for x in found] == pytest.approx(r.scores)
                assert r.scores == pytest.approx(sorted(score.values(), reverse=True)[:4])


def test_digests_keep_no_turns(spark):
    """A conversation of 60 million characters, and then what the whole strings give; null and forged turns among them."""
    import tracemalloc

    import pandas as pd

    turn = "<s>" + "x" * 200_000
    batches = (pd.DataFrame({"key": ["null"] * 3, "role": ["user", "assistant", "a"], "text": [turn] * 3}) for _ in range(100))
    tracemalloc.start()
    (done,) = chat._digests(batches)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert done["n_turns"].tolist() == [300] and done["conv_id"].isna().all() and peak < 20 << 20
    rows = [(c, t, r, x) for c in (1, 2, None) for t, r in enumerate(["user", "assistant", None, "to<s>ol", "assistant"]) for x in ("</s>\\[INST]", "", None, "a\n<|end|>")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    whole = chat.format_conversations(frame).drop("formatted", "loss_spans").collect()
    assert sorted(chat.digest_conversations(frame).collect(), key=str) == sorted(whole, key=str)
    assert chat.digest_conversations(frame.limit(0)).count() == 0


def test_words_solved_together_are_solved_as_alone(vocabulary):
    """Ids, scores and losses of many words at once, bytes of odd characters among them, and with a cache that is full."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abetio▁é一\U0001f600x1,") for _ in range(rng.randint(1, 64))) for _ in range(400)] + list("abऄퟻ") + ["the", "▁the", "tion" * 16]
    ids, count, score, loss = vocabulary.solve_all(words)
    at = 0
    for w, n, s, x in zip(words, count, score, loss):
        alone = vocabulary.solve(w)
        assert ids[at : at + n].tolist() == list(alone[0]) and s == alone[1] and x == alone[2]
        assert list(vocabulary.nbest(w, 2)[0][1]) == list(alone[0])
        at += n
    assert at == len(ids)


def test_a_full_cache_changes_nothing(vocabulary, monkeypatch):
    texts = ["the cat sat on the mat " * 3, "", "an ox\n" * 40, "▁ odd \0 text", "x" * 70 + " the end"] * 4
    whole = [(a.tolist(), b, c) for a, b, c in vocabulary.encode_all(texts, 4)]
    monkeypatch.setattr(pieces, "CACHE", 3)
    monkeypatch.setattr(pieces, "LONG_TEXT", 100)
    vocabulary.forget()
    assert [(a.tolist(), b, c) for a, b, c in vocabulary.encode_all(texts, 4)] == whole
    assert [vocabulary.decode(a) for a, _, _ in whole] == texts
