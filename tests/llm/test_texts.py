import random

import pytest

from sparkloom.llm import mojibake as M
from sparkloom.llm import ocr as O
from sparkloom.llm import personal as P
from sparkloom.llm import tokens as K

TEXTS = [None, "", " ", "\n\n  \t", "Hello world, it's 2024!", "数据库里的记录。", "<|endoftext|> is text", "a" * 3000, "é́ ​ \U0001f600👩‍👩", "x\r\n  y　z"]


def test_ids_against_the_library(spark, data):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(f"{K.tokenizer_dir()}/byte_bpe_50k.json")
    library.encode_special_tokens = True
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(TEXTS)] + [(10**6, None)], "doc_id long, text string")
    rows = docs.union(extra).collect()
    want = sorted((r["doc_id"], library.encode(r["text"] or "", add_special_tokens=False).ids) for r in rows)
    for hot in (K.HOT_WORDS, 50):
        got = K.encode_corpus(docs.union(extra).selectExpr("doc_id", "text", "1 as row", "2 as key"), hot_words=hot)
        assert sorted((r["doc_id"], r["ids"]) for r in got.collect()) == want
    sizes = K.count_tokens(docs.union(extra), hot_words=50)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in sizes.collect()) == [(i, len(x)) for i, x in want]


def test_decoding(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in K.decode_corpus(K.encode_corpus(docs)).collect()}
    assert got == {i: t or "" for i, t in enumerate(TEXTS)}
    assert K.encode_corpus(docs.where("doc_id < 0")).count() == 0


CLEAN = ["Die Übersicht über die Prüfung wäre schön, größtenteils.", "La réunion a été déplacée à demain, c’est réglé – enfin.", "El límite de páginas sigue vigente mañana por la mañana.", "请确认这份记录是否仍然有效，然后通知评审小组。", "The café terminal stayed near 21 °C – “nothing was lost”."] * 30


@pytest.fixture(scope="module")
def model():
    return M.Model(CLEAN)


@pytest.mark.parametrize("wrong", ["cp1252", "cp437", "cp1251", "mac_roman", "cp1250", "latin-1"])
def test_round_trips(model, wrong):
    for line in CLEAN[:5]:
        bad = M.damage(line, "utf-8", wrong)
        states = model.label([M.np.frombuffer(bad.encode("utf-32-le"), M.np.uint32)])[0]
        fixed, found, _ = M.repaired(bad, states, model)
        assert found and fixed == line


def test_clean_and_quoted_lines_stay(model):
    for line in [*CLEAN[:5], "plain", "The word “cafÃ©” is kept as an example.", "(U+FFFD, �) marks a lost byte.", "├── docs", "São Tolmeiro sends “NÃO LIDO”", ""]:
        states = model.label([M.np.frombuffer(line.encode("utf-32-le"), M.np.uint32)])[0] if line else M.np.zeros(0, int)
        fixed, found, _ = M.repaired(line, states, model)
        assert (fixed, found) == (line, 0)


def test_restore_in_spark(spark):
    bad = M.damage(CLEAN[0], "utf-8", "cp1252")
    rows = [(i, t) for i, t in enumerate(CLEAN)] + [(1000, bad), (1001, M.damage(bad, "utf-8", "cp1252")), (1002, f"first line\n{bad}\nlast"), (1003, None), (1004, ""), (1005, "f�r alle")]
    out = {r["doc_id"]: r for r in M.restore(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1000]["text"] == out[1001]["text"] == CLEAN[0] and out[1002]["text"] == f"first line\n{CLEAN[0]}\nlast"
    assert {i for i, r in out.items() if r["damaged"]} == {1000, 1001, 1002, 1005}
    assert out[1003]["text"] is None and out[1004]["text"] == ""


def test_every_document_counts(spark):
    """A script that only one long document has is known, and restored elsewhere."""
    line = "საქართველოს დედაქალაქი თბილისი"
    bad = M.damage(line, "utf-8", "cp1252")
    rows = [*enumerate(CLEAN), (1000, f"{line}\n" * 300), (1001, bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in M.restore(docs).collect()}
    assert out[1001]["text"] == line and {i for i, r in out.items() if r["damaged"]} == {1001}
    model, whole = M.fit(docs.repartition(3), "text"), M.Model([t for _, t in rows])
    assert (model.points == whole.points).all() and (model.log == whole.log).all()


def test_one_occurrence_is_known_in_any_corpus():
    counts = M.counted(CLEAN)
    counts[0] = counts[0] * 10**7
    counts[0][ord("ქ")] = 1
    assert M.Model(counts=counts).plausible("ქ") and not M.Model(counts=counts).plausible("უ")


LEXICON = P.Lexicon({"priya", "nadia", "felix", "lucía"}, {"marrowby", "o'thressel", "valdecuervo", "dunmoor"}, {"雨桐", "景行"})
CASES = [
    ("Reach Priya Dunmoor on +44 7700 900933 once", [("name", "Priya Dunmoor"), ("phone", "+44 7700 900933")]),
    ("From: Ms Marrowby TREFFLING+DESK@MAIL.VELKAMP.EXAMPLE", [("name", "Marrowby"), ("email", "TREFFLING+DESK@MAIL.VELKAMP.EXAMPLE")]),
    ("O'THRESSEL, Nadia approved; f. marrowby (at) nordquai (dot) example", [("name", "O'THRESSEL, Nadia"), ("email", "marrowby (at) nordquai (dot) example")]),
    ("SSN/ID 952-38-1478; tel 19045550139.", [("identity", "952-38-1478"), ("phone", "19045550139")]),
    ("moved to Flat 16, 153 Saltmarsh Ave, Port Ellery DX28 8TX last month", [("address", "Flat 16, 153 Saltmarsh Ave, Port Ellery DX28 8TX")]),
    ("收件地址：白沙湾市青岚区松柏路66号，电话 138 0000 4242。", [("address", "白沙湾市青岚区松柏路66号"), ("phone", "138 0000 4242")]),
    ("诸葛雨桐女士的证件号码是922713199002217593", [("name", "诸葛雨桐"), ("identity", "922713199002217593")]),
    ("Neue Anschrift: Lindenweg 136 b, 89094 Seenfeld", [("address", "Lindenweg 136 b, 89094 Seenfeld")]),
    ("Nueva dirección: Calle del Olivar 203, 31148 Puerto Olivo", [("address", "Calle del Olivar 203, 31148 Puerto Olivo")]),
    ("Nouvelle adresse : 10 impasse de la Source, 55898 Valfleur", [("address", "10 impasse de la Source, 55898 Valfleur")]),
    ("Project Amber Plover uses the Main Street template, section 12.", []),
    ("Row 912440 of 555012, offset 20794600, batch no. 4400 1299 8812, indexer@2.4.1 at 2025-03-14 10:22:31", []),
    ("", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_mentions(text, want):
    found = P.mentions(text, LEXICON)
    assert [(k, text[a:b]) for a, b, k in found if k != "name" or want] == want or [(k, text[a:b]) for a, b, k in found] == want
    out = P.redacted(text, found, b"key")
    for a, b, _ in reversed(found):
        assert out.endswith(text[b:])
        out = out[: len(out) - len(text[b:])]
        out = out[: out.rindex("[")]
        text = text[:a]
    assert out == text


def test_pseudonyms_are_permutations():
    for n in (1, 2, 3):
        images = {P.permuted(f"{i:0{n}d}", b"k", "t") for i in range(10**n)}
        assert len(images) == 10**n and all(len(x) == n for x in images)
    days = {P.permuted_range(i, 400, b"k", "d") for i in range(400)}
    assert days == set(range(400))
    code = "110105194912310021"[:17]
    code += P.check_sign(code)
    new = P.pseudonym(code, "identity", b"k")
    assert new[17] == P.check_sign(new[:17]) and new != code and 1900 <= int(new[6:10]) < 2100
    assert P.pseudonym("Priya Dunmoor", "name", b"k") == P.pseudonym("DUNMOOR, Priya", "name", b"k")
    assert len(P.pseudonym("a@b.example", "email", b"k")) == 20


SPELLINGS = [["+49 30 1234567", "0049 30 1234567", "030 1234567", "(030) 123-4567", "+49 (0)30 1234567"], ["+44 7700 900933", "07700 900 933"], ["+1 212 555 0193", "(212) 555-0193", "1-212-555-0193"], ["138 0000 4242", "+86 13800004242", "１３８-0000-4242"], ["+33 6 12 34 56 78", "06 12 34 56 78"]]


@pytest.mark.parametrize("ways", SPELLINGS)
def test_spellings_of_a_telephone_number(ways):
    """All give one pseudonym; prefix, trunk zero and layout stay."""
    new = [P.pseudonym(w, "phone", b"k") for w in ways]
    assert len({P.phone_parts(x)[1] for x in new}) == 1 and all(x != w for x, w in zip(new, ways, strict=True))
    for x, w in zip(new, ways, strict=True):
        assert P.phone_parts(x)[0] == P.phone_parts(w)[0] and P.phone_shape(P.phone_parts(x)[1]) == P.phone_shape(P.phone_parts(w)[1])
        assert [c for c in x if not c.isdecimal()] == [c for c in w if not c.isdecimal()] and len(x) == len(w)


def test_national_numbers_stay_valid():
    rng = random.Random(9)
    for _ in range(300):
        n = f"{rng.randrange(10**8):08d}"
        new = P.pseudonym(f"{n}-{P.SPANISH_LETTERS[int(n) % 23]}", "identity", b"k")
        assert new[9] == P.SPANISH_LETTERS[int(new[:8]) % 23] and new[8] == "-"
        n = rng.randrange(10**7)
        new = P.pseudonym(f"Y{n:07d}{P.SPANISH_LETTERS[int(f'1{n:07d}') % 23]}", "identity", b"k")
        assert new[0] == "Y" and new[8] == P.SPANISH_LETTERS[int("1" + new[1:8]) % 23]
        body = f"{rng.choice('12')}{rng.randrange(100):02d}{rng.randint(1, 12):02d}{rng.randint(1, 95):02d}{rng.randrange(10**6):06d}"
        new = P.pseudonym(f"{body[0]} {body[1:3]} {body[3:5]} {body[5:7]} {body[7:10]} {body[10:]} {97 - int(body) % 97:02d}", "identity", b"k")
        plain = new.replace(" ", "")
        assert plain[0] == body[0] and 1 <= int(plain[3:5]) <= 12 and 97 - int(plain[:13]) % 97 == int(plain[13:])
        ssn = f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
        new = P.pseudonym(ssn, "identity", b"k")
        assert new[:3] not in ("000", "666") and new[0] != "9" and new[4:6] != "00" and new[7:] != "0000" and new[3] == new[6] == "-"
        new = P.pseudonym(f"{rng.choice(P.NINO_PREFIXES)} {rng.randrange(100):02d} 34 56 {rng.choice('ABCD')}".lower(), "identity", b"k")
        assert new[:2].upper() in P.NINO_PREFIXES and new[-1] in "abcd" and new.islower()
    codes = {P.plain_code(f"A{i:02d}", b"k") for i in range(100)}
    assert len(codes) == 100 and P.pseudonym("c01x00t47", "identity", b"k").islower()


def test_numbers_of_one_kind_are_permuted():
    numbers = [f"{a:09d}" for a in range(665010001, 665010400)]
    assert len({P.american_number(n, b"k") for n in numbers}) == len(numbers)


def test_no_pseudonyms_without_a_key(spark):
    rows = spark.createDataFrame([("t", "1", "call 212-555-0193")], "source_table string, record_id string, text string")
    names = spark.createDataFrame([], "given_name string, lang string")
    assert P.find_mentions(rows, names).first()["redacted"] is None
    assert P.find_mentions(rows, names, b"k").first()["redacted"].startswith("call [phone:")
    assert P.secret_key(spark) != P.secret_key(spark)
    spark.conf.set(P.KEY_SETTING, "s")
    assert P.secret_key(spark) == b"s"
    spark.conf.unset(P.KEY_SETTING)


def test_rare_names_meet_their_texts(spark, monkeypatch):
    """Without any name in the tasks' lexicon the join finds the same mentions."""
    texts = [f"I met {g} {f} today." for g in ("Priya", "Nadia", "Wendell") for f in ("Marrowby", "Dunmoor", "O'Denwick")] * 4 + ["Ask Dr. Quistgard now.", "nadia O’DENWICK"] * 3 + ["苏雨桐女士来了", "樊雨桐先生来了", "岑雨桐先生", "请问司马雨桐在吗"] * 2
    rows = spark.createDataFrame([("t", str(i), t) for i, t in enumerate(texts)], "source_table string, record_id string, text string")
    names = spark.createDataFrame([("Priya", "en"), ("Nadia", "en")], "given_name string, lang string")
    want = sorted((r["record_id"], r["found"]) for r in P.find_mentions(rows, names).collect())
    monkeypatch.setattr(P, "HOT_SHARE", 2.0)
    assert P.learn_names(rows.select("text"), names).where("hot").count() == 2
    assert sorted((r["record_id"], r["found"]) for r in P.find_mentions(rows, names).collect()) == want


def test_names_are_learned(spark):
    texts = [f"I met {g} {f} today." for g in ("Priya", "Nadia", "Wendell") for f in ("Marrowby", "Dunmoor", "Oldenwick")] * 4 + ["Ask Dr. Quistgard now."] * 3 + ["苏雨桐女士来了", "樊雨桐先生来了", "岑雨桐先生"] * 2
    lexicon = P.learn_names(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([("Priya", "en"), ("Nadia", "en")], "given_name string, lang string"))
    got = {}
    for r in lexicon.collect():
        got.setdefault(r["kind"], set()).add(r["word"])
    assert got == {"family": {"marrowby", "dunmoor", "oldenwick", "quistgard"}, "given": {"priya", "nadia", "wendell"}, "han": {"雨桐"}}


def test_found_with_nulls_and_copies(spark):
    rows = [("t", "1", "call 212-555-0193"), ("t", "1", "call 212-555-0193"), ("t", "2", None), ("t", "3", "")]
    out = P.find_mentions(spark.createDataFrame(rows, "source_table string, record_id string, text string"), spark.createDataFrame([], "given_name string, lang string")).collect()
    assert {r["record_id"]: len(r["found"]) for r in out} == {"1": 1, "2": 0, "3": 0}


WORDS = ["contract", "contrast", "the", "summary", "names", "time", "tune", "embedding", "würfel", "document"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def trie_of(words):
    root = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = w
    return root


def test_automaton_is_complete():
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(200)})
    trie = trie_of(words)
    for _ in range(100):
        w = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 6)))
        for limit in (0, 1, 2):
            assert sorted(O.within(w, trie, limit)) == [x for x in words if distance(w, x) <= limit]


@pytest.mark.parametrize("branch", [20_000, 3])
def test_branches_hold_every_candidate(spark, branch, monkeypatch):
    """What the parts of the vocabulary give together is what a search of all pairs gives."""
    monkeypatch.setattr(O, "BRANCH", branch)
    rng = random.Random(5)
    letters = "clidrnmoe0"
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(400)})
    asked = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(100)})
    table = spark.createDataFrame([(w, 100) for w in words], "word string, n long")
    got = O.latin_candidates(spark.createDataFrame([(w, 0) for w in asked], "word string, count long"), table).collect()
    want = {(w, x, O.latin_kind(w, x)) for w in asked for x in words if distance(w, x) <= (1 if len(w) <= 3 else 2) and O.latin_kind(w, x)}
    assert want and sorted((r["word"], r["candidate"], r["kind"]) for r in got) == sorted(want)


@pytest.mark.parametrize(("word", "want"), [("c0ntract", "contract"), ("ernbedding", "embedding"), ("narnes", "names"), ("surnmary", "summary"), ("docurnent", "document"), ("†ime", "time"), ("zzz", None)])
def test_candidates(spark, word, want):
    table = spark.createDataFrame([(w, 100) for w in WORDS], "word string, n long")
    got = O.latin_candidates(spark.createDataFrame([(word, 0)], "word string, count long"), table).orderBy(O.F.desc("kind")).first()
    assert (got["candidate"] if got else None) == want


def test_line_ends(spark):
    counts = {"schedule": 9, "half": 9, "finished": 9, "half-finished": 9, "well": 3, "known": 3, "well-known": 3}
    lines = [("the sche-", "dule is"), ("the sche\xad", None), ("the sche-", None), ("a half-", "finished memo"), ("a well-", "known fact"), ("no mark", "here")]
    scanned = spark.createDataFrame([("r", str(i), 0, O.end_forms(a, b)) for i, (a, b) in enumerate(lines)], "source string, record_id string, line_no int, forms array<string>")
    cut = {r["record_id"] for r in O.cut_lines(scanned, spark.createDataFrame(list(counts.items()), "word string, n long")).where("hyphenation").collect()}
    assert cut == {"0", "1", "2"}


def test_places_and_neighbours_of_misread_words():
    counts, pairs = dict.fromkeys(["the", "is", "read"], 1), set()
    parts = O.Memo(lambda token: O.unknown_parts(token, counts))
    found = O.unknown_words("the c0ntract is rnead-", "so the", "y again", counts, pairs, parts)
    assert found == [(4, 8, "c0ntract", "the", "is")]  # the cut half is not looked at
    assert O.unknown_words("¿the ¡is! tbe", None, "read on", counts, pairs, parts) == [(10, 3, "tbe", "is", "read")]


def test_fixes_go_to_their_places(spark):
    fixes = [(0, 2, "it", 2), (8, 2, "in", 2), (9, 1, "x", 2)]
    row = spark.createDataFrame([("ii lit, ii", fixes), ("same", None)], "line string, fixes array<struct<pos:int,len:int,new:string,kind:int>>")
    assert [r[0] for r in row.select(O.mended("line", "fixes")).collect()] == ["it lit, in", "same"]


def test_words_beside_decide(spark):
    """One misread form is read in two ways, by what stands next to it."""
    texts = ["the old form was signed"] * 30 + ["they came from paris"] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    places = [("frorn", "old", "was"), ("frorn", "came", "paris")]
    cands = [("form", 2, 30), ("from", 2, 30)]
    rows = spark.createDataFrame([(*p, cands) for p in places], "word string, left string, right string, cands array<struct<candidate:string,kind:int,n:long>>")
    got = {r["left"]: r["candidate"] for r in O.in_context(rows, O.vocabulary(docs.select("text")), docs).collect()}
    assert got == {"old": "form", "came": "from"}


def test_paragraphs_run_on_over_pages(spark, monkeypatch):
    lines = [(1, 1, 0, "a", 0, "the first page ends in the impor-", None, True, None), (1, 2, 0, "b", 0, "tant word and goes on for a while", None, False, None), (1, 2, 1, "c", 0, "until here.", None, False, None), (1, 2, 2, "d", 0, "Another begins", None, False, None), (1, 2, 3, "e", 0, "- 2 -", "page_no", False, None)]
    rows = spark.createDataFrame(lines, "doc_id long, page int, ord int, record_id string, line_no int, line string, kind string, hyphenation boolean, fixes array<struct<pos:int,len:int,new:string,kind:int>>")
    for size in (2000, 1):
        monkeypatch.setattr(O, "PARAGRAPH_LINES", size)
        got = O.paragraphs(rows)
        text = {}
        for r in sorted(got.collect(), key=lambda r: (r["paragraph_no"], r["part"])):
            text[r["paragraph_no"]] = text.get(r["paragraph_no"], "") + r["text"]
        assert [t.rstrip() for t in text.values()] == ["the first page ends in the important word and goes on for a while until here.", "Another begins"]


def test_scans_in_spark(spark):
    body = ["The summary names the contract and the schedule of the", "second document which is half-", "finished, and the c0ntract is impor-", "tant for everybody in the document."]
    regions = []
    for page in range(1, 5):
        lines = ["Annual report – Part One", *body, f"- {page} -"]
        regions += [(f"r{page}_{k}", 1, page, k, line) for k, line in enumerate(lines)]
    schema = "region_id string, doc_id long, page_number int, region_order int, text string"
    regions += [regions[0], ("n1", 1, 1, 99, None), ("n2", None, None, None, "alone")]
    words = " ".join(body).replace("impor- tant", "important").replace("c0ntract", "contract").replace("half- finished", "half-finished")
    docs = spark.createDataFrame([(i, words) for i in range(30)] + [(99, None)], "doc_id long, text string")
    chunks = spark.createDataFrame([("c1", 1, None, 0, "\n".join(body) + "\n- 1 -", 1), ("c2", 1, "p", 1, "x", 1), ("c3", 1, None, 2, None, 1)], "chunk_id string, doc_id long, parent_chunk_id string, position int, text string, page_number int")
    a, b = O.examined(spark.createDataFrame(regions, schema), chunks, docs)
    found = {(r["record_id"], r["noise_type"]) for r in O.noise(a).collect()}
    assert found == {(f"r{p}_{k}", t) for p in range(1, 5) for k, t in ((0, "header"), (3, "misread"), (3, "hyphenation"), (5, "page_no"))}
    assert {(r["record_id"], r["noise_type"]) for r in O.noise(b).collect()} == {("c1", "misread"), ("c1", "hyphenation"), ("c1", "page_no")}
    text = " ".join(r["text"] for r in O.paragraphs(a).where("doc_id = 1").orderBy("paragraph_no").collect())
    assert text.count("contract is important for") == 4 and "half-finished" in text and "Annual" not in text and "- 2 -" not in text


def test_chunk_lines_that_no_region_has(spark):
    """Page numbers by their place and step, and halves of cut words by the chunk's next line."""
    words = "the cross is in the section of the document and the crosscheck is second to the report"
    docs = spark.createDataFrame([(i, words) for i in range(30)], "doc_id long, text string")
    regions = spark.createDataFrame([("r1", 1, 1, 0, "the document is second")], "region_id string, doc_id long, page_number int, region_order int, text string")
    rows = []
    for page, word in ((3, "report"), (4, "section"), (5, "document")):
        rows.append((f"a{page}", 1, None, 2 * page, f"the {word} is in the cross-\ncheck of the document\n1999\nthe second section", page))
        rows.append((f"b{page}", 1, None, 2 * page + 1, f"1999\nand the report\nis the {word}\n{page + 40}", page))
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id long, parent_chunk_id string, position int, text string, page_number int")
    _, b = O.examined(regions, chunks, docs)
    assert {(r["record_id"], r["noise_type"]) for r in O.noise(b).collect()} == {(f"a{p}", "hyphenation") for p in (3, 4, 5)} | {(f"b{p}", "page_no") for p in (3, 4, 5)}
    text = [r["text"] for r in O.paragraphs(b).collect()]
    assert len(text) == 1 and text[0].count("the crosscheck of") == 3 and "44" not in text[0] and text[0].count("1999") == 6


GATED = ["anna.lee(at)example.com", "jean [at] exemple (point) fr", "at 221\nBaker Street", "at 221 Old\nBaker Street", "(Calle Mayor 5)", "«Am Markt 7»", "rue:\tAlte Gasse 12", "10115 Berlin, Lindenring 7", "75011 Lyon, 12 boulevard Voltaire", "NI: QQ 12 34 56 7", "ID：A1234567", "A1234567 is my ID.", "12\u2003rue\u2003Mercier"]


@pytest.mark.parametrize("text", GATED)
def test_gates_let_every_match_through(text):
    """What a pattern matches is found, whatever the words that gate it."""
    matched = [p for p in (P.EMAIL, P.LABELLED_ID, P.NAMED_ID, *P.ADDRESSES) if p.search(text)]
    assert matched and any(t in ("email", "identity", "address") for _, _, t in P.mentions(text, P.Lexicon(set(), set(), set())))


def test_generated_gates():
    rng = random.Random(3)
    lexicon = P.Lexicon(set(), set(), set())
    space = lambda: rng.choice([" ", "\n", "\t", "\u3000"])
    for _ in range(2000):
        before = rng.choice(["", "(", "“", "/", "x ", "\n", "3"])
        words = rng.choice(["12 rue", "12 Bd", "Calle", "Camino", "Am", "Im", "Zum", "Alter", "Lange", "10115 Ulm, Lange", "5 Old", "221 Baker", "Postfach", "B.P.", "P.O. Box"]).split(" ")
        text = before + space().join([*words, rng.choice(["Mayor", "Markt", "hof", "Lindenweg", "Damm", "Street", "Road", "Mercier", "77"]), "14"])
        kinds = lexicon.kinds_in(text.lower())
        for i, p in enumerate(P.ADDRESSES):
            assert not p.search(text) or (str(i) in kinds if i else P.EN_STREET.search(text)), (i, text)


@pytest.mark.parametrize("text", ["a good idea 1234567 times", "a nice 12345 night"])
def test_short_labels_are_words(text):
    assert P.mentions(text, P.Lexicon(set(), set(), set())) == []
