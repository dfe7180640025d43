import pytest

from emberframe.llm.sentences import segment, sentences


def split(text, lang=None):
    return [text[a:b] for a, b in segment(text, lang)]


@pytest.mark.parametrize(
    "lang, parts",
    [
        ("en", ["Dr. Lee met Lt. Roe at 5 p.m. near No. 4.", "It cost 3.5 m/s... then it fell.", "Who drew this?!", "The U.S. tally, e.g. of J. K. Fox, is over."]),
        ("en", ['"Is it open? We wait," asked Sgt. Fox.', 'He wrote: "It held."', "(All stayed open.)", "By noon it stood at 398.", "389 were masked.", "We lost maps, etc.", "The end came at 9 a.m.", "Stop!"]),
        ("de", ["Am 3. Mai kam Dr. Rau, d. h. spät.", "Einige, z. B. die bei Ulm, fehlten.", "„Wasser marsch!“, rief Kosk.", "Er schrieb: „Die Linie hält.“", "Es fehlten Karten usw.", "Der 2. Trupp blieb."]),
        ("es", ["«¡Agua ya!», gritó Sol.", "Llegó a las 3:39 p. m. desde Lit.", "¿Quién avisó?", "Véase la pág. 3 del Dr. Mar, p. ej. hoy.", "Total: 910.507 plantas."]),
        ("fr", ["« Reculez ! » a crié Jean.", "Évacuez Briv !", "M. Roux a lu p. 4, env. 3,5 km.", "Qui a prévenu le poste ?", "(Personne n'est revenu.)"]),
        ("hi", ['"रेखा टिक गई है।" लोसागा ने कहा।', "डॉ. राम ने 421 बिंदु गिने।", "यह कैसे हुआ?!", "वर्षा 34.8 मिमी रही।"]),
        ("ar", ["«هل انتهى الحريق؟» سأل القائد.", "سجل د. سامي نحو 70 نقطة.", "لماذا حدث هذا؟!", "بلغ المطر 22.4 مم."]),
        ("th", ["ไม่มีใครกลับไปอีก", "ฝนตกเพียง 26.1 มิลลิเมตร", "ลมเปลี่ยนทิศ"]),
    ],
)
def test_languages(lang, parts):
    for given in (lang, None, "und", lang.upper()):
        assert split(" ".join(parts), given) == parts
    assert split("\n \n".join(parts), lang) == parts
    if lang != "th":
        assert split("\n".join(parts), lang) == parts


@pytest.mark.parametrize(
    "parts",
    [
        ["“还能走吗？”白云说。", "队员记下：“风向已变。”", "风速10.3米。", "为什么？！", "烟雾……", "（无人返回。）"],
        ["「水をくれ！」と峰が叫んだ。", "煙で谷が見えない…", "（誰も戻らない。）", "なぜか？！", "彼は「止まった。」と言った。"],
    ],
)
def test_unspaced(parts):
    assert split("".join(parts)) == parts


def test_marks_without_partners_and_odd_input():
    assert split('He said "no. Then he left. It rained.') == ['He said "no.', "Then he left.", "It rained."]
    assert split("") == split(" \n\n \t") == [] and split("...") == ["..."] and split("no end") == ["no end"]
    assert split("Heading\n\nText one.\nstill one. Two.") == ["Heading", "Text one.\nstill one.", "Two."]
    text = "Word. " * 20000
    assert len(segment(text)) == 20000
    assert len(segment('He wrote: "It held. So." ' * 20000)) == 20000
    assert len(segment("(« " * 30000 + "End] " * 30000 + "word. Yes.")) == 2


def test_frame(spark):
    d = spark.createDataFrame([(1, " One. Two.", "en"), (2, None, "en"), (3, "", None), (1, " One. Two.", "en")], "doc_id long, text string, lang string")
    got = sorted(tuple(x) for x in sentences(d).collect())
    assert got == [(1, 1, 1, 5), (1, 1, 1, 5), (1, 2, 6, 10), (1, 2, 6, 10)]
    assert sentences(d.limit(0)).count() == 0


def test_layout_does_not_hide_what_rules_look_at():
    for gap in (" ", "\n" + " " * 30, " " * 40, " " * 300):
        assert split(f"Ask Dr.{gap}Smith. It rained.", "en") == [f"Ask Dr.{gap}Smith.", "It rained."]
        assert split(f"Er kam am{gap}3.{gap}Mai an. Es regnete.", "de") == [f"Er kam am{gap}3.{gap}Mai an.", "Es regnete."]
        assert split(f"\u201cRun!\u201d{gap}said the guard. It rained.", "en") == [f"\u201cRun!\u201d{gap}said the guard.", "It rained."]
        assert split(f"It burned.{gap}Then it rained.", "en") == ["It burned.", "Then it rained."]


@pytest.mark.parametrize("gap", [" ", " " * 17, " " * 29, " " * 80, "\n" + " " * 4000, " " * 50_000])
def test_no_length_of_blanks_hides_what_rules_look_at(gap):
    assert split(f"Er kam am{gap}3. Tag. Es regnete.", "de") == [f"Er kam am{gap}3. Tag.", "Es regnete."]
    assert split(f"It weighs al.{gap}lower case. Yes.", "en") == [f"It weighs al.{gap}lower case.", "Yes."]
    assert split(f'"Run!"{gap}Captain Joe Smith{gap}said. It rained.', "en") == [f'"Run!"{gap}Captain Joe Smith{gap}said.', "It rained."]
    assert split(f"Dies gilt z.{gap}B.{gap}heute, i.{gap}d.{gap}R.{gap}Nie so.", "de") == [f"Dies gilt z.{gap}B.{gap}heute, i.{gap}d.{gap}R.{gap}Nie so."]


def test_long_words_and_sentences_are_seen_whole():
    word = "x" * 100_000
    assert split(f'"Run!" {word.title()} said. Ok {word} Dr. Lee. Yes.', "en") == [f'"Run!" {word.title()} said.', f"Ok {word} Dr. Lee.", "Yes."]
    assert split(f"{word}Dr. Lee came.", "en") == [f"{word}Dr.", "Lee came."]


@pytest.mark.parametrize("text", ["a.", "A. ", "1. ", '"a."B', "é.", "(a. ", "am        3. "])
def test_many_marks_cost_linear_time(text):
    import time

    began = time.perf_counter()
    segment(text * 60_000, "de")
    assert time.perf_counter() - began < 20


def test_abbreviations_belong_to_their_language():
    assert split("He got a D. Then he left.", "en") == ["He got a D.", "Then he left."]
    assert split("That was the max. Then we stopped.", "en") == ["That was the max.", "Then we stopped."]
    assert split("It was in the Col. Then he left.", "en") == ["It was in the Col.", "Then he left."]
    assert split("Dr. He came with J. The Fox.", "en") == ["Dr. He came with J. The Fox."]
    assert split("Die Zahl ist max. Zehn von uns.", "de") == ["Die Zahl ist max. Zehn von uns."]


def test_stated_languages_without_function_words():
    assert split("O Exmo. Sr. Silva chegou. Depois saiu.", "pt") == ["O Exmo. Sr. Silva chegou.", "Depois saiu."]
    assert split("Ecco il sig. Rossi. Poi piove.", "it") == ["Ecco il sig. Rossi.", "Poi piove."]
    assert split("Pan Dr. Novak szedł. Potem padało.", "pl") == ["Pan Dr. Novak szedł.", "Potem padało."]
    assert split("불이 났다. 비가 왔다.", "ko") == ["불이 났다.", "비가 왔다."]


@pytest.mark.parametrize("form", ["NFC", "NFD"])
def test_accents_composed_or_not(form):
    import unicodedata

    text = unicodedata.normalize(form, "Véase la pág. 3 de máx. Ríos y más. Él vino.")
    assert len(split(text, "es")) == 2
    text = unicodedata.normalize(form, "Er kam am 4. März. Es ging.")
    assert len(split(text, "de")) == 2
