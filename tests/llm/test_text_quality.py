import numpy as np
import pytest

from pulsegrid.llm import text_quality as Q

DOC = "doc_id bigint, text string, words string, chars string"
PROSE = {
    "en": "It has been found that the wear of the seat depends on the position of the spindle with respect to the port. A person skilled in the art will understand that both can be exchanged.",
    "de": "Aus dem Stand der Technik ist bekannt, dass die Elektrode im Betrieb verschleißt. Wird die Grenze von 95 °C überschritten, so löst sich das Gehäuse selbsttätig.",
    "fr": "Il en résulte que la précision de mesure augmente d’environ 48 %. Lors du montage, la bague est d’abord mise en place, puis le ressort est collé.",
    "es": "Durante el montaje se coloca primero la carcasa y después se pega la correa. Según la figura 17, el electrodo está unido a el eje mediante una pieza (22).",
    "ja": "本発明は、電極と測定部とを備える装置に関する。なお、保持部は省略してもよい。温度が57℃を超えると、弁体は初期位置に戻る。",
    "zh": "需要说明的是，放大电路可以省略。因此，可以防止支架与壳体相互接触。当温度超过67℃时，阀芯返回初始位置。",
}
JUNK = {
    "bullets": "\n".join(f"• {w} housing," for w in "seat valve spring cover plate bushing".split()),
    "signs": "\n".join(f"{i} tubular spindle" for i in range(10, 30, 2)),
    "tabs": "\n".join(f"Ex. {i}\t{i * 1.7:.2f}\t{i * 3.1:.1f}\tn.d." for i in range(12)),
    "bars": "\n".join(f"| {i * 1.7:.2f} | {i * 3.1:.1f} | <0.1 |" for i in range(12)),
    "html": "\n".join(f"<tr><td>{i * 1.7:.2f}</td><td>{i * 3.1:.1f}</td></tr>" for i in range(12)),
    "pairs": "\n".join(f"wear of the seat -> {i * 7.3:.2f} % by weight" for i in range(12)),
    "base64": "I8Rl3eaNzfGAOnla2L032sxMWsOgAfE4GDRjELYM6THpnTKZTJaceoO26vPjdzp+nnym0FelkcB7\n" * 5,
    "hex": "\n".join(f"0000{i:02x}  41 71 f3 f6 0d af 05 bd 36 14 8d 0b 91 62 8e bf" for i in range(8)),
    "boxes": "t▯■¤a■▯▯¤ae▯¤¤ n▯�¤ □¤□▯�?▯ n�  ¤��¤¤aa▯■¤?¤□a",
    "soup": "{^ n_.·¡°[r*  ]-[.e*r^  n^c r:>|ur* ~I]i!] *e /\n" * 4,
    "menu": "\n".join(["Print  Share  Save", "Cited by 33", "Legal status", "<< Back", "Sign in", "Family members (4)"] * 2),
    "stars": "* * * * *\n" * 6,
    "one line": " ".join(f"• {w} housing," for w in "seat valve spring cover plate bushing".split() * 6),
}


def ids(spark, texts):
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], DOC)
    return {r.doc_id for r in Q.without_prose(Q.text_statistics(df)).collect()}


def test_prose_and_junk_are_told_apart(spark):
    prose = list(PROSE.values())
    with_headings = [f"Title of it\n\nABSTRACT\n{t}\n\nCLAIMS\n1. {t}" for t in prose]
    shouted = [t.upper() for t in prose]
    wrapped = ["\r\n".join(t[i : i + 60] for i in range(0, len(t), 60)) for t in prose[:4]]
    texts = [*prose, *with_headings, *shouted, *wrapped]
    assert ids(spark, texts) == set()
    junk = list(JUNK.values())
    assert ids(spark, junk) == set(range(len(junk)))


def test_shares_follow_the_mixture(spark):
    text = PROSE["en"] + "\n" + JUNK["tabs"]
    r = Q.text_statistics(spark.createDataFrame([(1, text, "", "")], DOC)).first()
    ink = lambda s: sum(not c.isspace() for c in s)
    assert r.prose_share == pytest.approx(ink(PROSE["en"]) / ink(text), abs=0.02)
    assert r.prose_share + r.list_share + r.table_share + r.junk_share == pytest.approx(1)
    assert r.chars == ink(text) and r.lines == 13


def test_null_empty_blank_and_repeated(spark):
    df = spark.createDataFrame([(1, None, "", ""), (2, "", "", ""), (3, " \n\t　", "", ""), (4, "Hi there.", "", ""), (4, "Hi there.", "", "")], DOC)
    got = sorted(((r.doc_id, r.chars, r.words, r.line_end_share, r.profile) for r in Q.text_statistics(df).collect()), key=str)
    assert got[:3] == [(1, 0, 0, 0.0, None), (2, 0, 0, 0.0, None), (3, 0, 0, 0.0, None)] and got[3] == got[4] and got[3][:4] == (4, 8, 2, 1.0)
    assert Q.without_prose(Q.text_statistics(df.where("doc_id < 4"))).count() == 0
    assert Q.text_statistics(df.where("false")).count() == 0


def test_a_text_is_described_alike_alone_and_among_others():
    texts = [*PROSE.values(), "", *JUNK.values(), "x"]
    together = Q.describe(texts)
    for i, t in enumerate(texts):
        alone = Q.describe([t])
        for k, v in alone.items():
            assert v[0] == together[k][i] or v[0] == pytest.approx(together[k][i]), (k, t[:20])


def test_a_very_long_text(spark):
    text = (PROSE["en"] + " ") * 8000
    r = Q.text_statistics(spark.createDataFrame([(1, text, "", "")], DOC)).first()
    assert r.prose_share > 0.99 and r.words == 8000 * len([w for w in PROSE["en"].split()])


def test_divergence():
    p = np.array(list(Q.PROFILES.values()))
    near, d = Q.nearest_profile(p / p.sum(axis=1, keepdims=True))
    assert near.tolist() == list(range(len(p))) and np.abs(d).max() < 1e-9


def test_a_sentence_with_few_function_words_is_no_heading():
    text = "Improved barrel for compact imaging optics\nSummary\nThe object is achieved by a mirror having the features set out in the independent claims."
    d = Q.describe([text, "housing\nvalve seat\ncover plate\nspring washer\nbushing\nsealing ring"])
    assert d["prose_share"][0] > 0.5 and d["prose_share"][1] == 0


def test_language_of_the_function_words():
    got = Q.describe([*PROSE.values(), "42 | 17", ""])["language"].tolist()
    assert got == [*PROSE, "", ""]


def test_function_words_of_several_languages_do_not_add_up():
    """Names with particles of many languages are no sentence of any."""
    d = Q.describe(["Garcia y Vega\nvon Berg und Söhne\nDupont et Cie\nSmith and Jones\nRossi\nvan Dyck"])
    assert d["prose_share"][0] == 0
