"""Residue: evidence in several languages, sentences that only speak about it, boilerplate and dirty rows."""

import re

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from geolathe.llm.residue import ERRORS, FILLERS, FILTER, SCRIPTS, _repeats, evidence, line_evidence, mended, residue

YES = [
    ("field", "This patent concerns {{inventor_list}}."), ("field", "[0003] ${abstract}"), ("field", "Ref. <filing_date goes here> / [title – to be completed]"), ("field", "1. [INSERT title HERE]"), ("field", "[hier Titel einsetzen]"), ("field", "__pub_number__"),
    ("field", "[à compléter : abstract]"), ("field", "[điền figure_ref]"), ("field", "【请填写发明名称】"), ("field", "%%applicant%%"), ("field", "<%= priority.date %>"), ("field", "&lt;title&gt;"), ("field", "%(embodiment)s"), ("field", "@@drawing_sheet@@"),
    ("filler", "Lorem ipsum ullamco nostrud labore consectetur nostrud laboris amet."), ("filler", "Placeholder claim."), ("filler", "Texto de relleno."), ("filler", "xxxxx xxxxx xxxxx xxxx"), ("filler", "此处为占位文字，请替换为正文。"), ("filler", "Dies ist ein Blindtext."),
    ("error", "Error 503: Gateway Timeout."), ("error", "404 Not Found"), ("error", "Your session has expired."), ("error", "Traceback (most recent call last):"), ("error", "java.lang.NullPointerException"), ("error", "Die Seite wurde nicht gefunden (Fehler 404)."), ("error", "您访问的页面不存在。"),
    ("error", "El servicio no está disponible en este momento."), ("error", "Lỗi 404: không tìm thấy trang yêu cầu."), ("error", "Réessayez dans 5 minutes."), ("script", "Please enable JavaScript to view the full text."), ("script", "JavaScript ist deaktiviert."), ("script", "请启用脚本后再查看全文。"),
    ("script", "Veuillez activer JavaScript pour consulter ce document."), ("script", "<noscript>Scripts are switched off in your browser.</noscript>"), ("script", "Vui lòng bật JavaScript để xem toàn văn."),
]
NO = [
    "In a further embodiment the template engine (12) replaces each marker of the form {{field}} by the stored value.", "The variable ${name} in the shell of the pump housing holds the serial number; it's read 12 times.", "The parser of the seal lip skips text between <% and %> and counts the tokens [[ and ]] as brackets.",
    'A line of filler text such as "lorem ipsum" is used to measure the width of the display (4).', 'The placeholder part (8) is removed before the mast is inserted; "insert here" is embossed on the ring.', 'An error message "Service Unavailable" lights the lamp (3) for 9 s, which tells the driver to wait.',
    "The server answers with status code 404 Not Found where the unit has no entry, and the client then repeats the request.", "Where JavaScript is disabled in the browser of the operator, the lip is shown as a static image.", 'Die Fehlerseite "Seite nicht gefunden" wird vom Steuergerät (8) nach 20 ms unterdrückt.',
    "Le serveur renvoie l'erreur 404 lorsque la plaque est hors tension.", "Si JavaScript está desactivado, el panel muestra una tabla fija (6).", "Khi máy chủ báo lỗi 503, ống nối dùng dữ liệu lưu sẵn.", "当服务器返回错误503时，导轨切换到本地数据。",
    "A TODO list (7) of the controller keeps open tasks, each with an undefined or a defined state.", "[math: \\frac{a_{12}}{", "$F = \\frac{2 \\cdot m}{r^{2}}$", "##STR00012##", '<maths num="3"/>', "�� = 12 �/m2", "DETAILED DESCRIPTION", "claim 3, wherein the error is below 4 %.", "EQU.1",
]


@pytest.mark.parametrize("kind,text", YES)
def test_evidence(kind, text):
    assert line_evidence(text) == kind


@pytest.mark.parametrize("text", NO)
def test_no_evidence(text):
    assert line_evidence(text) is None


def test_mended_lines():
    bad = "Bitte versuchen Sie es später erneut.".encode().decode("latin-1")
    assert line_evidence(bad) == "error" and mended("P1ease enab1e JavaScript") == "Please enable JavaScript"


D = "doc_id bigint, text string, source string, kind int, evidence string"


def test_documents(spark, rows):
    good = "Pump\nABSTRACT\nA pump comprises a ring.\nCLAIMS\n1. A pump."
    data = [(i, good, f"s{i % 2}", 0, "") for i in range(60)]
    data += [(100, good + "\nYour session has expired.", "s0", 0, ""), (101, None, "s0", 0, ""), (102, "", "s0", 0, ""), (103, "  \n ", "s1", 0, ""), (104, good + "\n" + "\n".join(NO), "s1", 0, ""), (105, "Please enable JavaScript to read.", None, 0, ""), (105, "Please enable JavaScript to read.", None, 0, "")]
    data += [(106, good + "\r\n" + "x y z. " * 40_000 + "\r\n{{title}}", "s1", 0, "")]
    assert rows(residue(spark.createDataFrame(data, D))) == [(100, ["error"]), (105, ["script"]), (106, ["field"])]
    assert rows(residue(spark.createDataFrame([], D))) == []


def test_boilerplate_is_subtracted_but_not_from_pages_of_nothing_else(spark, rows):
    foot = "Please enable JavaScript to see the map."
    data = [(i, f"Text number {chr(97 + i % 26)}{chr(97 + i // 26)} of its own.\n{foot}", "s", 0, "") for i in range(200)]
    data += [(900, foot, "s", 0, ""), (901, f"Other text.\n{foot}\nError 404: Not Found.", "s", 0, "")]
    assert rows(residue(spark.createDataFrame(data, D))) == [(900, ["script"]), (901, ["error"])]
    assert evidence(foot) == "script"


SAMPLES = ["405 Method Not Allowed", "301 Moved Permanently", "402 Payment Required", "Undefined index", "Access to this record has been restricted.", "Access to this page is blocked.", "Le document demandé n'a pas été trouvé.", "Le document demandé n’existe pas.", "Dịch vụ hiện không hoạt động.", "访问的页面已删除。", "访问的页面已移除。", "会话已超时。", "登录已失效。", "无权访问。", "Scripting is disabled.", "Example title", "Example abstract.", "Example description", "<claims go here>", "< FIELD_NAME >", "<title>404</title>", "N.N."]


MORE = [
    ("error", "[0005] Loading…"), ("error", "[object Object] undefined undefined NaN"), ("error", "Der Dienst ist vorübergehend nicht verfügbar."), ("error", "[0006] java.lang.NullPointerException"), ("error", "[0004] Traceback (most recent call last):"),
    ("error", "HTTP/1.1 301 Moved Permanently"), ("error", "405 Method Not Allowed"), ("error", "402 Payment Required"), ("error", "<title>404</title>"), ("error", "Undefined index"), ("error", "404 Not Found"),
    ("error", "Coming soon"), ("error", "Sorry, we couldn't find that page."), ("error", "La página que busca no existe"), ("error", "ページが見つかりません。"), ("error", "페이지를 찾을 수 없습니다."), ("script", "JavaScriptを有効にしてください。"), ("script", "자바스크립트를 활성화해 주세요."),
    ("field", "[TITLE]"), ("field", "{abstract}"), ("field", "$NAME$"), ("field", "%TITLE%"), ("field", "Dear [COMPANY NAME],"), ("filler", "ここにテキストを入力"),
]


@pytest.mark.parametrize("kind,text", MORE)
def test_more_evidence(kind, text):
    assert line_evidence(text) == kind


@pytest.mark.parametrize("text", [r"$F = \frac{2 \cdot m}{r^{2}}$", r"\text{if} x", "{x | x ≥ 89} ∪ {y}", "x_{max}", "The loading of the platform is limited to 3 t.", "a set {a, b}", "[SUMMARY OF 12]", "The page under construction is printed first.", "[math: a]", "[0012] A null value is stored."])
def test_formulas_and_speech_are_none(text):
    assert line_evidence(text) is None


def test_messages_over_two_lines(spark, rows):
    good = "Pump\nABSTRACT\nA pump comprises a ring.\nCLAIMS\n1. A pump."
    data = [(1, good + "\nPlease enable\nJavaScript to read the text.", "s", 0, ""), (2, good + "\nThis text is long.\nJavaScript", "s", 0, ""), (3, "Please try\r\nagain later.", "s", 0, ""), (4, good, "s", 0, "")]
    assert rows(residue(spark.createDataFrame(data, D))) == [(1, ["script"]), (3, ["error"])]


@pytest.mark.parametrize("pattern", range(len([*ERRORS, *SCRIPTS, *FILLERS])))
def test_filter_passes_what_any_pattern_matches(pattern):
    p = [*ERRORS, *SCRIPTS, *FILLERS][pattern]
    letters = st.characters(codec="utf-8", exclude_categories=["Cs", "Cc"])

    @settings(max_examples=6, deadline=None, derandomize=True, database=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(re.compile(p, re.I), alphabet=letters))
    def check(text):
        a = pa.array([text])
        assert pc.match_substring_regex(a, FILTER)[0].as_py() or _repeats(a)[0]

    check()


@pytest.mark.parametrize("text", [t for _, t in YES + MORE] + SAMPLES)
def test_filter_passes_what_is_evidence(text):
    passes = pc.match_substring_regex(pa.array([text]), FILTER)[0].as_py()
    assert passes or not line_evidence(text)
