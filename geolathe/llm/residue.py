"""Documents that hold template residue, filler, error messages or script notices in place of content.

Method: every text is cut into lines; normalised lines are counted by host (the source a document came from), and lines
that recur in a large part of a host's documents are boilerplate, which is subtracted. The sentences of the lines that are left are
held against evidence of four kinds: unfilled template fields, filler, error messages, script notices. Sentences that
speak about or quote such things are no evidence: quoted text is taken out first, and what is left must address the
reader, stand alone as a message, or hold a field in place of a value. A record that has no line but boilerplate is judged by
all its lines. An RE2 filter over whole texts picks the documents whose sentences are looked at one by one.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parse
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolathe.session import materialize, ship

BOILER_SHARE = 0.2  # of a host's documents
BROKEN_LINE = 120  # characters up to which a line may be half of a message broken over two
BOILER_DOCS = 25  # at least so many documents

# Words of pseudo-Latin filler.
LOREM = set(
    "lorem ipsum dolor sit amet consectetur consetetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua "
    "enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit "
    "voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit "
    "anim id est laborum sadipscing nonumy eirmod invidunt aliquyam erat diam voluptua".split()
)

# What may stand in a field: a name of letters of any script, digits, blanks, dots and underscores.
_X = r"[^\W\d][\w .|:/-]{1,60}?"
# What is written in capitals in brackets when it is to be filled in.
_NOUN = "TITLE|NAME|DATE|ABSTRACT|CLAIMS?|TEXT|DESCRIPTION|SUMMARY|CONTENT|APPLICANT|INVENTORS?|AUTHOR|COMPANY|ADDRESS|NUMBER|CITY|COUNTRY|EMAIL|PHONE|YEAR|URL|LINK|IMAGE|TITEL|DATUM|TITRE|NOM|FECHA|NOMBRE"
_FIELDS = [
    rf"\{{\{{\s*[#/^>&]?\s*{_X}\s*\}}\}}", rf"\{{%\s*{_X}\s*%\}}", rf"[$#]\{{\s*{_X}\s*\}}", rf"<%[=-]?\s*{_X}\s*-?%>", rf"<<\s*{_X}\s*>>",
    rf"\[\[\s*{_X}\s*\]\]", rf"@@\s*{_X}\s*@@", rf"%%\s*{_X}\s*%%", rf"%\({_X}\)[sdf]", rf"(?<![\w_])__{_X}__(?![\w_])",
    r"(?<![\\\w^_}{$])\{[^\W\d_]{3,}(?:[ _.-][^\W\d_]+){0,4}\}(?![\w^_{])", r"\$(?-i:[A-Z][A-Z_]{2,40})\$", r"%(?-i:[A-Z][A-Z_]{2,40})%", rf"[\[<](?-i:(?:[A-Z]+[ _])*(?:{_NOUN})(?:[ _][A-Z]+)*)[\]>]",
    rf"(?:<|&lt;)\s*[^\W\d]\w*_\w+\s*(?:>|&gt;)", rf"&lt;\s*{_X}\s*&gt;", rf"<\s*{_X}\s+(?:goes|go|comes) here\s*>", rf"<\s*(?:insert|enter|your|add)\s+{_X}\s*>",
]
# In brackets a field needs a word that asks for filling in.
_ASK = r"insert|enter|add|tbd|tba|tbc|todo|fill in|fill|to be (?:completed|defined|added|filled|inserted|confirmed)|your|placeholder|einsetzen|einfügen|eintragen|ausfüllen|ergänzen|platzhalter|insertar|introducir|completar|rellenar|indicar|insérer|à compléter|à insérer|à remplir|compléter|remplir|saisir|indiquer|điền|nhập|chèn|bổ sung|вставить|заполнить|указать|inserire|inserir|请填写|请输入|填写|填入|插入|待填|待补|输入"
_FIELDS += [rf"[\[【〔]\s*(?:[^\]】〕\n]{{0,60}}?[\s:–-])?(?:{_ASK})(?:[\s:–-][^\]】〕\n]{{0,60}})?\s*[\]】〕]", rf"[\[【〔](?:请填写|请输入|填写|填入|插入|待填|待补)[^\]】〕\n]{{0,40}}[\]】〕]"]
FIELD = re.compile("|".join(_FIELDS), re.I)
# Words of a text about templates and code, in which a field is an example.
ABOUT = re.compile(
    r"\b(markers?|variables?|parsers?|tokens?|template engine|templates?|syntax|delimiters?|brackets?|shell|macros?|expressions?|compilers?|interpreters?|escape|"
    r"marken?|vorlagen?|variablen?|platzhalter|marqueurs?|modèles?|gabarits?|balises?|marcadore?s?|plantillas?|etiquetas?)\b|biến|bản mẫu|变量|模板|标记|占位符|解析",
    re.I,
)
_STOP = {"and", "or", "und", "oder", "et", "ou", "y", "o", "và", "hoặc", "to", "bis"}

_s = r"^\W*(?:\[?[\dOo]{1,5}\]?[.)]?\s+)?"  # the start of a message, behind a paragraph number
# Sentences of programs and sites to their reader, by language; each is a whole message or its start.
ERRORS = [
    _s + r"(?:http(?:/\d(?:\.\d)?)?\s+)?(?:error|status|fehler|erreur|lỗi|código|code|ошибка)?\s*:?\s*[345]\d\d\s*[:–-]?\s*(?:not found|gone|forbidden|unauthorized|bad request|bad gateway|gateway time-?out|service (?:temporarily )?unavailable|internal server error|too many requests|request timeout|moved permanently|method not allowed|payment required)\W*$",
    _s + r"(?:error|fehler|erreur|lỗi|ошибка|erro|errore)\s*\d{3,4}\s*[:：–-]", _s + r"错误\s*\d{3,4}\s*[:：]", r"<title>\s*\d{3}\b", r"<h1>\s*(?:\d{3}\s*)?(?:not found|gone|forbidden|bad gateway|gateway time-?out|service unavailable|internal server error|too many requests|error|access denied)",
    _s + r"(?:bad gateway|gateway time-?out|internal server error|service (?:temporarily )?unavailable|page not found|not found|forbidden|access denied|permission denied|connection (?:refused|reset|timed out)|request timed out)\W*$",
    r"^\W*traceback \(most recent call last\)", r"^\W*file \"[^\"\n]*\", line \d+", r"^\W*(?:\w+\.)*[a-z]\w*(?:error|exception)(?::|\W*$)", r"^\W*(?:exception in thread|caused by:|uncaught \w+error|fatal error:|segmentation fault|stack trace:)", r"^\s*at [\w$.]+\([\w.]+:\d+\)", r"\bsqlstate\s*\[",
    r"^\W*(?:warning|notice|fatal error|parse error)\s*:\s.*\b(?:on line \d+|cannot|can't|failed|undefined|unable)", r"\bora-\d{5}\b", r"^\W*(?:nullpointerexception|undefined index)",
    r"\byour session (?:has )?(?:expired|timed out|ended)", r"\b(?:please )?(?:log|sign) in again\b", r"\bsomething went wrong\b", r"^\W*oops\b", r"\b(?:could|can) ?not be (?:delivered|loaded|displayed|retrieved|opened|found)\b.*(?:\bpublication\b|\bpage\b|\bdocument\b|\brecord\b|\btext\b|\bserver\b)?\W*$(?<!\d\.)",
    r"\b(?:page|publication|document|record|file|text|content|resource) (?:you (?:asked for|requested|are looking for)|requested)\b", r"\bhas been moved or\b", r"\bno longer available at this\b", r"\btoo many requests from\b", r"\bwait \d+ (?:seconds|minutes) (?:before|and)\b", r"\baccess to this (?:record|page|document|resource|site|publication|content|server) (?:is|has been|was) (?:denied|forbidden|restricted|blocked)", r"\bupstream server (?:sent|returned|gave|did)",
    r"\bplease (?:try|go back|reload|refresh|retry|contact (?:the )?(?:administrator|support|webmaster))\b", r"\btry again (?:later|in (?:a few|some|\d+))", r"\b(?:you do(?:n't| not) have permission|you are not authori[sz]ed)\b", r"\b(?:unable|failed) to (?:load|open|fetch|retrieve|connect to) (?:the |this |your )?(?:page|document|text|record|file|server|content|resource|database|claims|description|abstract)\b",
    r"\bseite (?:wurde |konnte |kann )?nicht (?:gefunden|geladen|angezeigt)", r"\b(?:ansprüche|beschreibung|zusammenfassung|text|dokument|inhalt|volltext|datei|dokuments?) (?:können|kann|konnte|konnten) nicht (?:geladen|angezeigt|gefunden|geöffnet|abgerufen)", r"\bbitte versuchen sie es\b", r"\bversuchen sie es (?:später|erneut|in)\b", r"\bihre sitzung ist abgelaufen\b", r"\bzugriff (?:verweigert|auf diese \w+ (?:verweigert|nicht))", r"\b(?:dienst|seite|server|text|dokument) (?:ist )?(?:leider )?(?:derzeit |zurzeit |momentan |vorübergehend |zeitweise |im moment )*(?:nicht verfügbar|nicht erreichbar|außer betrieb)\W*$",
    r"\b(?:document|page|texte|publication|fichier) (?:demandée?|recherchée?) (?:est introuvable|n'existe pas|n'a pas)", r"\bréessayez (?:dans|plus tard)", r"\bveuillez réessayer\b", r"\bpage (?:est )?introuvable\b", r"\bvotre session (?:a expiré|est expirée)", r"\baccès (?:refusé|interdit|à ce(?:tte)? \w+ (?:est )?(?:refusé|interdit))", r"\bservice (?:est )?(?:temporairement |momentanément |actuellement )?indisponible", r"\bune erreur (?:s'est produite|est survenue)",
    r"\bno se (?:encontró|ha encontrado|pudo (?:cargar|encontrar|mostrar|abrir)|puede (?:cargar|mostrar)) (?:la|el|los|las)? ?(?:página|documento|texto|archivo|recurso|publicación|contenido|descripción|resumen|reivindicaciones)", r"\bel servicio no está disponible\b", r"\bint[eé]nt[ae]lo (?:de nuevo|más tarde|otra vez)", r"\bvuelva a intentarlo\b", r"\b(?:su|la) sesión ha (?:caducado|expirado)\b", r"\bacceso (?:denegado|prohibido)\W*$", r"\bpágina no encontrada\b", r"\bse ha producido un error\b",
    r"không tìm thấy (?:trang|tài liệu|tệp|nội dung|văn bản)", r"vui lòng thử lại", r"hãy thử lại", r"không thể (?:tải|mở|hiển thị) (?:trang|tài liệu|nội dung|văn bản|toàn văn|tệp|yêu cầu)", r"phiên (?:làm việc|đăng nhập)[^.]{0,20} đã hết hạn", r"truy cập bị từ chối", r"dịch vụ (?:hiện )?(?:tạm thời )?không (?:khả dụng|có sẵn|hoạt động)", r"trang (?:bạn )?(?:yêu cầu|truy cập)[^.]{0,20}không tồn tại", r"đã xảy ra lỗi",
    r"(?:访问|请求|查找|浏览)的?(?:页面|网页|文件|文献|文档|内容|资源)(?:不存在|已(?:删除|移除|失效)|未找到|找不到)", r"请稍[后候](?:再试|重试|再)", r"无法(?:加载|打开|显示|访问)(?:该|此|本)?(?:文献|文件|页面|网页|文档|内容|全文)", r"(?:会话|登录)已?(?:过期|超时|失效)", r"(?:拒绝访问|访问被拒绝|没有权限访问|无权访问)", r"服务(?:暂时|暂|目前)?不可用", r"页面(?:不存在|未找到|找不到)", r"(?:服务器|系统)(?:内部)?(?:繁忙|错误)[，,。！!]",
    r"\[object object\]", r"\bundefined[\s,;]+(?:undefined|null|nan)\b", r"^\W*(?:undefined|null)\W*$",
    r"^\W*(?:loading|please wait|wird geladen|bitte warten|chargement(?: en cours)?|veuillez patienter|cargando|carregando|caricamento(?: in corso)?|đang tải|vui lòng chờ|加载中|正在加载|载入中|请稍候|загрузка|読み込み中|ロード中|로딩 ?중|불러오는 중)\W*$", r"^\W*(?:(?:this |the )?(?:page|site|content|text) (?:is )?)?(?:coming soon|under construction)\W*$",
    r"\bsorry,? (?:but )?(?:we|this|that|the|your|there|an?|something)\b", r"\bwe (?:could(?: not|n't)|can(?:not|'t)|were unable to|are unable to) (?:find|load|display|process|open|complete) (?:that|this|the|your)\b", r"\bpágina (?:que (?:busca|buscas|solicita|solicitó|ha solicitado) )?(?:ya )?no (?:existe|está disponible|se encuentra)",
    r"\bpage (?:que vous (?:cherchez|recherchez|demandez|avez demandée) )?n'existe (?:pas|plus)", r"(?:ページ|文書|ファイル|資料)が(?:見つかりません|存在しません|表示できません)", r"エラーが発生しました", r"(?:しばらく|後で|もう一度)[^。]{0,12}(?:お試し|やり直し)", r"アクセスが(?:拒否|禁止)", r"(?:페이지|문서|파일)를? ?(?:찾을|표시할|열) 수 없습니다", r"오류가 발생(?:했습니다|하였습니다)", r"다시 시도해 ?주(?:세요|십시오)", r"접근이 (?:거부|제한)",
    r"\bpagina (?:is )?niet gevonden", r"\bstron(?:a|y) nie (?:została )?(?:znalezion|istnieje)", r"\bsayfa bulunamad",
    r"страница не найдена", r"попробуйте (?:позже|ещё раз|еще раз|снова)", r"доступ (?:запрещ[её]н|закрыт)", r"произошла ошибка", r"pagina non trovata", r"riprova(?:re)? più tardi", r"página não encontrada", r"tente novamente",
]
SCRIPTS = [
    r"<noscript\b", r"\b(?:please|kindly) (?:enable|activate|turn on|switch on|allow) (?:java ?script|scripts?|scripting|cookies)\b", r"^\W*(?:\[?\d+\]?\s*)?(?:enable|activate|turn on|switch on|allow) (?:java ?script|scripts|cookies)\b", r"\byou (?:need|have|must|should) (?:to )?(?:enable|activate|turn on|switch on|allow) (?:java ?script|scripts?|cookies)\b", r"\b(?:java ?script|scripts?) (?:is|are|must be|has to be|need to be|needs to be) (?:required|needed|enabled|turned on|switched on|activated|allowed) (?:to|for|in order|by|on)\b",
    r"\b(?:requires?|needs?) (?:java ?script|scripts)(?: to (?:be|run|work)| enabled)?\b.{0,30}$", r"^\W*(?:\[?\d+\]?\s*)?(?:java ?script|scripts?|scripting) (?:is|are) (?:disabled|turned off|switched off|deactivated|blocked|not enabled|required|off)\W*$", r"\byour browser (?:does(?: not|n't)|has|is|blocks?|cannot|can't)\b.{0,40}(?:scripts?|javascript|cookies|supported)", r"\b(?:scripts?|java ?script) (?:is|are) (?:switched|turned) off in your browser\b", r"\bcheck that scripts are allowed\b", r"\b(?:in|with) your browser and reload\b", r"\bwithout java ?script (?:enabled )?(?:this|the) (?:page|site|text|app|viewer)\b",
    r"\bbitte (?:aktivieren|erlauben|schalten) sie (?:java ?script|skripte|cookies)\b", r"^\W*(?:\[?\d+\]?\s*)?(?:java ?script|skripte) (?:ist|sind) (?:deaktiviert|ausgeschaltet|nicht aktiviert|erforderlich|notwendig)\W*$", r"\baktivieren sie (?:bitte )?(?:java ?script|skripte|cookies)\b", r"\b(?:java ?script|skripte) (?:muss|müssen|ist|sind) (?:in ihrem browser )?(?:aktiviert|erforderlich|eingeschaltet) (?:sein|werden|um)", r"\bihr browser (?:unterstützt|führt|hat|blockiert)\b",
    r"\bveuillez (?:activer|autoriser) (?:java ?script|les scripts|les cookies)\b", r"^\W*(?:\[?\d+\]?\s*)?activez (?:java ?script|les scripts|les cookies)\b", r"^\W*(?:\[?\d+\]?\s*)?(?:java ?script|les scripts) (?:est|sont) (?:désactivée?s?|requise?s?|nécessaires?|obligatoires?)\W*$", r"\bvous devez activer (?:java ?script|les scripts)\b", r"\bvotre navigateur\b.{0,40}(?:scripts?|javascript)",
    r"^\W*(?:\[?\d+\]?\s*)?(?:active|activa|habilite|habilita|permita) (?:java ?script|los scripts|las cookies)\b", r"\bpor favor,? (?:active|habilite|permita) (?:java ?script|los scripts)\b", r"^\W*(?:\[?\d+\]?\s*)?(?:java ?script|los scripts) (?:está|están|es|son) (?:desactivad[oa]s?|deshabilitad[oa]s?|necesari[oa]s?|obligatori[oa]s?)\W*$", r"\b(?:debe|necesita|es necesario) (?:activar|habilitar) (?:java ?script|los scripts)\b", r"\bsu navegador\b.{0,40}(?:scripts?|javascript)",
    r"(?:vui lòng|hãy|cần|xin) (?:bật|kích hoạt|cho phép) (?:java ?script|tập lệnh|script)", r"trình duyệt của bạn.{0,40}(?:java ?script|tập lệnh|script)", r"^\W*java ?script (?:đã )?bị (?:tắt|vô hiệu)[^.]{0,10}\W*$", r"请(?:先|您)?(?:启用|开启|打开|允许|激活)(?:您的)?(?:浏览器的?)?(?:java ?script|脚本)", r"(?:您的)?浏览器(?:不支持|未启用|禁用了?|已禁用|没有启用)(?:java ?script|脚本)", r"(?:需要|必须)(?:启用|开启|打开)(?:java ?script|脚本)(?:才能|后)", r"java ?scriptを(?:有効|オン)に", r"(?:자바 ?스크립트|java ?script)를? ?(?:활성화|사용|켜)", r"schakel (?:java ?script|scripts) in", r"włącz(?:yć)? (?:obsługę )?java ?script", r"включите (?:java ?script|скрипты)", r"abilita(?:re)? java ?script", r"(?:ative|habilite) o java ?script",
]
FILLERS = [
    _s + r"(?:this is )?(?:an? )?(?:sample|dummy|filler|placeholder|example) (?:paragraph|text|claim|abstract|title|description|content|section|heading|sentence|summary|copy)\W*$", r"^\W*(?:\[?\d+\]?\.?\s*)?(?:placeholder|filler|dummy) (?:claim|text|paragraph|abstract|title|description)\b(?! \()", r"\b(?:overwrite|replace) this (?:text |paragraph |line |sentence |placeholder )?(?:with|by)\b", r"\byour (?:abstract|title|text|claims?|description|summary|content)(?: text)? (?:starts|goes|comes|begins|here)\b", r"\b(?:type|write|insert|enter|put|paste) your (?:text|abstract|title|claims?|description|summary|content)\b", r"\b(?:text|content|abstract|description|title|claims?) (?:goes|to follow|to be added|to be inserted|comes) ?(?:here|later)?\W*$(?<!\d\.)", r"\bblah[\s,]+blah\b", r"\bdelete this (?:text|paragraph|line|before)\b", r"\bto be (?:deleted|removed|replaced) before (?:filing|publication|publishing)\b",
    r"\bblindtext\b", r"\bdies ist ein (?:platzhalter|mustertext|beispieltext|fülltext)", r"^\W*(?:\[?\d+\]?\.?\s*)?(?:platzhalter|mustertext|beispieltext|fülltext)(?:text)?\W*$", r"\ban dieser stelle (?:steht|folgt|kommt|erscheint)\b", r"\bhier (?:steht|folgt|kommt) (?:später |noch |dann )?(?:der|die|das|ein|ihr|ihre)\b.{0,40}(?:text|beschreibung|zusammenfassung|titel|anspr)", r"\bvor (?:der )?(?:veröffentlichung|einreichung) (?:ersetzen|löschen|entfernen|zu ersetzen|zu löschen)",
    r"\btexte? de remplissage\b", r"^\W*(?:\[?\d+\]?\.?\s*)?(?:texte|paragraphe|contenu) (?:d'exemple|factice|fictif|provisoire)", r"\bà (?:supprimer|remplacer) avant (?:le dépôt|la publication|publication|dépôt)", r"\bce texte (?:doit être|est à) (?:remplacé|remplacer|supprimé)", r"\btexto de (?:relleno|ejemplo|muestra|prueba)\b", r"\b(?:sustituir|reemplazar|eliminar|borrar) antes de (?:publicar|presentar|la publicación)\b", r"\b(?:sustituya|reemplace) este texto\b",
    r"nội dung mẫu", r"văn bản (?:mẫu|giữ chỗ|tạm)", r"vui lòng thay thế", r"(?:此处|这里|此)为?(?:占位|填充|示例|样例)(?:文字|文本|内容|段落)", r"请(?:替换|删除|修改)(?:为|成|此|本)", r"(?:占位|填充)(?:文字|文本)[，,。]", r"(?:示例|样例)(?:文字|文本|段落)\W*$", r"(?:サンプル|ダミー)テキスト", r"ここに(?:テキスト|本文|タイトル|内容)", r"(?:예시|더미|샘플) (?:텍스트|문구)", r"여기에 (?:내용|텍스트|제목)", r"здесь будет (?:текст|описание)", r"текст-заполнитель", r"testo segnaposto",
    r"^\W*(?:\[?\d+\]?\.?\s*)?(?:tbd|tba|todo|fixme|xxx+|n\.?n\.?)\b\s*[:.]?\s*\W*$", r"^\W*(?:todo|fixme|tbd)\s*[:–-]", r"(?a:\b([a-z]{3,6})([ ,]{1,2})\1\b(?:\2\1\b)+)", r"\b(?:asdf|qwerty|qwertz|jkl)\b.{0,12}\b(?:asdf|qwerty|qwertz|jkl|asdf)\b", r"\b(x{3,})(?:\s+x{2,}){2,}", r"\b(?:foo bar|foobar) baz\b",
]
_flags = re.I | re.U
KINDS = {"error": re.compile("|".join(f"(?:{p})" for p in ERRORS), _flags), "script": re.compile("|".join(f"(?:{p})" for p in SCRIPTS), _flags)}
# Backreferences number their groups, so fillers stay apart.
FILLER = [re.compile(p, _flags) for p in FILLERS]

QUOTED = re.compile(r"\"[^\"\n]{0,200}\"|“[^”\n]{0,200}”|„[^“”\n]{0,200}[“”]|«[^»\n]{0,200}»|‘[^’\n]{3,200}’|『[^』\n]{0,200}』|「[^」\n]{0,200}」|``[^'\n]{0,200}''")
# A sentence that states a condition or a course of events; a message to the reader inside it is part of the subject.
COURSE = re.compile(r"^\W*(?:\[?[\dOo]{1,5}\]?\.?\s+)?(?:(?:where|when(?:ever)?|while|if|as soon as|wenn|sobald|falls|lorsque|quand|si|cuando|khi|nếu|когда|если)\b|当|如果|若)", re.I)



WIDE = {"claim", "claims", "abstract", "text", "title", "description", "summary", "content", "steht"}  # in lines of all kinds; another part of the pattern is taken


def _literals(p) -> set[str] | None:
    """Strings of which every match of a parsed pattern holds one, as long as can be; None if there are none."""
    weight = lambda f: min(1 if x in WIDE else len(x) for x in f)
    best, run = None, ""
    for op, arg in [*p, (None, None)]:
        if op is sre.LITERAL:
            run += chr(arg)
            continue
        found = [{run.strip()}] if run.strip() else []
        run = ""
        if op is sre.SUBPATTERN:
            found.append(_literals(arg[-1]))
        elif op is sre.BRANCH:
            parts = [_literals(x) for x in arg[1]]
            found.append(None if None in parts else set().union(*parts))
        elif op is sre.MAX_REPEAT and arg[0]:
            found.append({chr(arg[2][0][1]) * arg[0]} if arg[2][0][0] is sre.LITERAL else _literals(arg[2]))
        for f in found:
            if f and (best is None or weight(f) > weight(best)):
                best = f
    return best


def _parts(patterns: list[str]) -> str:
    out = set()
    for p in patterns:
        # Of a pattern with a branch as short as a letter, "n.n.", the field below says that branch.
        out |= {x for x in _literals(sre_parse.parse(p.removeprefix(_s), re.I)) if len(x) > 1}
    # Scripts stand as a word or behind java, not inside "description".
    say = {"script": r"(?:^|[^\pL]|java ?|no)script"}
    return "|".join(say[x] if x in say else re.escape(x).replace("\\ ", " ").replace("'", "['’]") for x in sorted(out) if not any(y != x and y in x for y in out))


def _re2(p: str) -> str:
    """A pattern as RE2 reads it, which matches wherever Python's does: signs of any script, no look-around and no word limits, which RE2 has for ASCII only."""
    out, i, inside = [], 0, False
    while i < len(p):
        c = p[i]
        if p.startswith(("(?<!", "(?!", "(?<=", "(?="), i):
            depth, cls = 0, False
            while True:
                if p[i] == "\\":
                    i += 1
                elif cls:
                    cls = p[i] != "]"
                elif p[i] == "[":
                    cls = True
                else:
                    depth += (p[i] == "(") - (p[i] == ")")
                i += 1
                if not depth:
                    break
            continue
        if c == "\\":
            wide = {"w": "\\pL\\pM\\pN_", "d": "\\p{Nd}", "s": "\\s\\pZ"}.get(p[i + 1])
            out.append(("" if p[i + 1] == "b" else p[i : i + 2]) if not wide else wide if inside else f"[{wide}]")
            i += 2
            continue
        inside = c == "[" or (inside and c != "]")
        out.append(c)
        i += 1
    return "(?i)" + "".join(out)


# Cheap parts of all of the above for RE2; what they miss cannot be evidence. Openings of fields and words of filler stand here, the
# rest is taken from the patterns; words said thrice (the one pattern with a backreference) are found by _repeats.
OPENS = (
    r"(?i)\{\{|\{%|\{[\pL]{3}[\pL _.-]*\}|\$(?-i:[A-Z][A-Z_]+)\$|%(?-i:[A-Z][A-Z_]+)%|[\[<](?-i:[A-Z][A-Z _]+)[\]>]|[$#]\{|<%|<<|\[\[|@@|%%|%\(|__[^\s_]|&lt;|(?:goes|go|comes) here|[\[【〔][^\]】〕\n]{0,60}(?:insert|enter|add|tbd|tba|tbc|todo|fill|to be|your|placeholder|einsetz|einfüg|eintrag|ausfüll|ergänz|platzhalter|introducir|complet|rellenar|indi[cq]|insér|remplir|compl|saisir|điền|nhập|chèn|bổ sung|вставить|заполнить|указать|inserir|填|输入|插入|待补)|<[\s\pZ]*(?:insert|enter|your|add)|<[\s\pZ]*[\pL_][^>]*_"
    r"|lorem|ipsum|adipisc|consectetur|eiusmod|incididunt|ullamco|nostrud|laboris|aliqua"
)
FILTER = OPENS + r"|(?:^|[^\pL])n\.?n(?:[^\pL]|$)|\([\pL\pN_.]+:\p{Nd}+\)|" + _parts([p for p in [*ERRORS, *SCRIPTS, *FILLERS] if r"\1" not in p and r"at [\w$.]" not in p])
# Sentences that can be evidence: the patterns whole, but for the one with a backreference, and what the rules of fields and filler begin with.
# RE2 keeps a small table of states, so they go in portions.
_ALL = [p for p in [*ERRORS, *SCRIPTS, *FILLERS] if r"\1" not in p]
CAN = [_re2("|".join(f"(?:{p})" for p in _ALL[i : i + 25])) for i in range(0, len(_ALL), 25)] + [OPENS]
# Lines that may read otherwise once mended: UTF-8 read as Windows-1252, ligatures, digits inside words.
BROKEN = r"[ÃÂÄÅ][\x{80}-\x{17e}\x{192}\x{2c6}-\x{2dc}\x{2013}-\x{203a}\x{20ac}\x{2122}]|á[º»]|[åæçèéä][\x{80}-\x{bf}\x{152}-\x{178}\x{192}\x{2c6}\x{2dc}\x{2013}-\x{203a}\x{20ac}\x{2122}]|[ﬀ-ﬄ]|\p{L}[01]+\p{L}|\b[01]\p{L}{2}|\p{L}{2}[01]\b|\x{ad}|\x{200b}"
_word = re.compile(r"[^\W\d_]+")
_sentence = re.compile(r"(?<=[.!?。！？…])[\"'”»]?\s+|(?<=[。！？])")


def mended(line: str) -> str:
    """The line with UTF-8 that was read as Windows-1252 read again, ligatures opened, and 1 and 0 inside words as l and o."""
    if any(c in line for c in "ÃÂÄÅáæåçèéï"):
        try:
            raw = b"".join(bytes([ord(c)]) if ord(c) < 256 and not 0x80 <= ord(c) < 0xA0 else c.encode("cp1252") if ord(c) > 255 else bytes([ord(c)]) for c in line)
            line = raw.decode()
        except (UnicodeEncodeError, UnicodeDecodeError):
            pass
    if "ﬁ" in line or "ﬂ" in line or "ﬀ" in line:
        line = line.replace("ﬃ", "ffi").replace("ﬄ", "ffl").replace("ﬁ", "fi").replace("ﬂ", "fl").replace("ﬀ", "ff")
    if _scan.search(line):
        line = _scan.sub(lambda m: m[0].replace("1", "l").replace("0", "o"), line)
    return line.replace("­", "").replace("​", "").replace("’", "'")


_scan = re.compile(r"(?<![\w])(?=[^\W_]*[a-zà-ỹ])[^\W\d_]*[01][^\W_]*[^\W\d_][^\W_]*|(?<=[a-zà-ỹ])[01](?=[a-zà-ỹ])")


NUMBER = re.compile(r"^\s*(?:\[[\dOoIl]{1,5}\]\s*|\d{1,3}[.)]\s+)")  # of a paragraph or claim


def evidence(sentence: str) -> str | None:
    """The kind of evidence a sentence gives, as it stands or behind the number of a paragraph or claim: field, filler, error, script, or None."""
    return _evidence(sentence) or (_evidence(sentence[m.end() :]) if (m := NUMBER.match(sentence)) else None)


_file = re.compile(r'^\W*file "', re.I)
_quote = re.compile("[\"“„«‘『「`]")


def _bare(sentence: str) -> str:
    """Without what is quoted; a stack frame keeps its file."""
    return QUOTED.sub(' "" ', sentence) if _quote.search(sentence) and not _file.match(sentence) else sentence


def _evidence(sentence: str) -> str | None:
    code = _bare(sentence)
    bare = QUOTED.sub(' "" ', sentence)
    for m in FIELD.finditer(bare):
        inner = re.sub(r"[^\w ]+", " ", m[0]).split()
        if inner and not (len(inner) == 1 and inner[0].lower() in _STOP) and sum(map(str.isalpha, "".join(inner))) >= 2:
            rest = FIELD.sub(" ", bare)
            if not ABOUT.search(rest):
                return "field"
            break
    words = [w.lower() for w in _word.findall(bare)]
    if words:
        latin = sum(w in LOREM for w in words)
        if latin >= 4 and latin >= 0.7 * len(words) and ({"lorem", "ipsum", "adipiscing", "consectetur", "eiusmod", "incididunt", "ullamco", "nostrud", "laboris", "aliqua"} & set(words)):
            return "filler"
        if "lorem ipsum" in bare.lower() and not re.search(r"\b(text|such as|word)", bare, re.I):
            return "filler"
    about = COURSE.match(bare)
    if not about:
        if KINDS["script"].search(bare):
            return "script"
        if KINDS["error"].search(code):
            return "error"
        if any(p.search(bare) for p in FILLER):
            return "filler"
    elif re.search(r"nothing (?:appears|is shown|happens)", bare, re.I) and KINDS["script"].search(bare):
        return "script"
    return None


def _norm(lines: pa.Array) -> pa.Array:
    """Lower case, digit runs as 0, white space as one blank."""
    s = pc.utf8_lower(pc.replace_substring_regex(lines, r"[0-9]+", "0"))
    return pc.utf8_trim_whitespace(pc.replace_substring_regex(s, r"\s+", " "))


def _repeats(lines: pa.Array) -> np.ndarray:
    """Lines that say a word of 3 to 6 letters three times over, which RE2 cannot find: bytes are compared with those one word and sign later."""
    off = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1]
    hit = np.zeros(len(lines), bool)
    if not len(lines) or off[-1] == off[0]:
        return hit
    data = np.concatenate([np.frombuffer(lines.buffers()[2], np.uint8)[off[0] : off[-1]] | 0x20, np.full(9, 0x20, np.uint8)])  # the last word may end the text
    letter = (data >= 97) & (data <= 122)
    start = letter.copy()
    start[1:] &= ~letter[:-1]
    n = len(data)
    for step in range(4, 9):  # the word and one or two signs
        if n < 3 * step:
            break
        # Word starts whose next two words start as many bytes later and hold the same bytes.
        i = np.flatnonzero(start[: n - 3 * step + 1] & start[step : n - 2 * step + 1] & start[2 * step : n - step + 1])
        for k in range(1, max(3, step - 2)):  # at least these are letters of the word
            i = i[(data[i + k] == data[i + k + step]) & (data[i + k] == data[i + k + 2 * step])]
        i = i[data[i] == data[i + step]]
        hit[np.searchsorted(off - off[0], i, side="right") - 1] = True
    return hit


LINES = "kind tinyint, host string, line bigint, n bigint, doc_id bigint, evidence array<bigint>, kinds array<string>, lines array<bigint>"


def _scan_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, len(b), 1000):
            yield from _scan_batch(b.slice(lo, 1000))


def _scan_batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    text = b.column("text")
    docs = pc.split_pattern_regex(text, r"\r\n|\n|\r|\x{2028}|\x{0B}|\x{0C}")
    counts = pc.list_value_length(docs).to_numpy()
    flat = docs.flatten()
    norm = _norm(flat).to_numpy(zero_copy_only=False)
    hashes = pd.util.hash_array(norm, categorize=True).view(np.int64)
    of = np.repeat(np.arange(len(b)), counts)
    full = norm != ""
    # Each line counts once a document; batches send sums, not lines.
    one = pd.DataFrame({"d": of[full], "h": hashes[full]}).drop_duplicates()
    host = pc.fill_null(b.column("host"), "").to_numpy(zero_copy_only=False)
    code, hosts = pd.factorize(host)
    sums = one.assign(k=code[one.d.to_numpy()]).groupby(["k", "h"]).size()
    k, h = sums.index.get_level_values(0).to_numpy(), sums.index.get_level_values(1).to_numpy()
    n_docs = np.bincount(code)
    # Host totals travel as kind 0 with no line.
    names = ["kind", "host", "line", "n", "doc_id", "evidence", "kinds", "lines"]
    longs, texts = pa.list_(pa.int64()), pa.list_(pa.string())

    def rows(kind, host_, line, n, doc=None, ev=None, kinds=None, lines=None):
        m = len(host_)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(m, kind, np.int8)), pa.array(host_, pa.string()), pa.array(line, pa.int64()), pa.array(n, pa.int64()), doc if doc is not None else pa.nulls(m, pa.int64()), pa.array(ev, longs) if ev is not None else pa.nulls(m, longs), pa.array(kinds, texts) if kinds is not None else pa.nulls(m, texts), pa.array(lines, longs) if lines is not None else pa.nulls(m, longs)],
            names=names,
        )

    yield rows(0, hosts, [None] * len(hosts), n_docs)
    yield rows(1, hosts[k], h, sums.to_numpy())
    # The sentences of the few lines that pass the filter, as they are or mended, are looked at one by one.
    like = pc.match_substring_regex(flat, FILTER)
    like = pc.or_(like, pa.array(_repeats(flat)))
    broken = pc.and_not(pc.match_substring_regex(flat, BROKEN), like)
    pick = np.flatnonzero(like.to_numpy(zero_copy_only=False) & full)
    fix = np.flatnonzero(broken.to_numpy(zero_copy_only=False) & full)
    if len(fix):
        new = pa.array([mended(v) for v in flat.take(pa.array(fix)).to_pylist()], pa.string())
        pick = np.sort(np.concatenate([pick, fix[pc.match_substring_regex(new, FILTER).to_numpy(zero_copy_only=False)]]))
    kind_of = line_evidences(flat.take(pa.array(pick)).to_pylist())
    found: dict[int, list[tuple[int, str]]] = {}
    for i, k_ in zip(pick.tolist(), kind_of):
        if k_:
            found.setdefault(int(of[i]), []).append((int(hashes[i]), k_))
    # A message may be broken over two lines: short neighbours of which the first ends within a sentence are read as one, too.
    short = pc.less_equal(pc.utf8_length(flat), BROKEN_LINE).to_numpy(zero_copy_only=False) & full
    within = pc.invert(pc.match_substring_regex(flat, r"[.!?。！？…:;]\s*$")).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(short[:-1] & short[1:] & within[:-1] & (of[:-1] == of[1:]))
    if len(first):
        both = pc.binary_join_element_wise(pc.utf8_rtrim_whitespace(flat.take(pa.array(first))), pc.utf8_ltrim_whitespace(flat.take(pa.array(first + 1))), " ")
        hit = np.flatnonzero(pc.match_substring_regex(both, FILTER).to_numpy(zero_copy_only=False))
        told = set(pick[[i for i, k_ in enumerate(kind_of) if k_]].tolist())
        hit = np.array([h for h in hit if first[h] not in told and first[h] + 1 not in told], np.int64)
        for at, k_ in zip(first[hit].tolist(), line_evidences(both.take(pa.array(hit)).to_pylist())):
            if k_:
                found.setdefault(int(of[at]), []).append((int(hashes[at]), k_))
    ends = np.cumsum(counts)
    keep = sorted(found)
    evs, kinds = [[h_ for h_, _ in found[d]] for d in keep], [[k_ for _, k_ in found[d]] for d in keep]
    all_lines = [hashes[ends[d] - counts[d] : ends[d]][full[ends[d] - counts[d] : ends[d]]].tolist() for d in keep]
    if keep:
        yield rows(2, host[keep], [None] * len(keep), [None] * len(keep), b.column("doc_id").take(pa.array(keep)), evs, kinds, all_lines)


def line_evidence(line: str) -> str | None:
    return line_evidences([line])[0]


def line_evidences(lines: list[str]) -> list[str | None]:
    """The kind of the first sentence of each line that gives evidence. RE2 says which sentences can; these are looked at one by one."""
    out: list[str | None] = [None] * len(lines)
    of, sentences, read, at = [], [], [], []
    for i, line in enumerate(lines):
        for s in _sentence.split(mended(line)):
            if s:
                of.append(i)
                sentences.append(s)
                bare = _bare(s)
                read.append(bare)
                at.append(len(of) - 1)
                if m := NUMBER.match(s):
                    read.append(_bare(s[m.end() :]))
                    at.append(len(of) - 1)
    a = pa.array(read, pa.string())
    may = _repeats(a)
    for p in CAN:
        may |= pc.match_substring_regex(a, p).to_numpy(zero_copy_only=False)
    for j in sorted({at[k] for k in np.flatnonzero(may)}):
        if not out[of[j]]:
            out[of[j]] = evidence(sentences[j])
    return out


def residue(docs: DataFrame, *, host: str = "source", boiler_share: float = BOILER_SHARE, boiler_docs: int = BOILER_DOCS) -> DataFrame:
    """(doc_id, kinds): the documents to leave out, with the kinds of evidence in order: error, field, filler, script.

    docs: doc_id, text and the host column; others are ignored. Null, empty and blank texts are no cases, texts of any length
    are read whole, a null host is a host of its own, repeated rows give a row once, empty tables none.
    """
    ship(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), "text").where(F.length("text") > 0)
    s = materialize(d.mapInArrow(_scan_texts, LINES), "lines")
    totals = s.where("kind = 0").groupBy("host").agg(F.sum("n").alias("docs"))
    cand = s.where("kind = 2").select("host", "doc_id", "evidence", "kinds", "lines")
    counted = s.where("kind = 1").groupBy("host", "line").agg(F.sum("n").alias("n")).where(F.col("n") >= boiler_docs)
    # A host has at most (lines per document) / boiler_share recurrent lines.
    boiler = counted.join(totals, "host").where(F.col("n") >= boiler_share * F.col("docs")).groupBy("host").agg(F.collect_set("line").alias("boiler"))
    cand = cand.join(boiler, "host", "left").withColumn("boiler", F.coalesce("boiler", F.array().cast("array<bigint>")))
    # forall is true of a document that has no line but boilerplate: then all its evidence counts.
    only = F.size(F.array_except("lines", "boiler")) == 0
    left = F.filter(F.arrays_zip("evidence", "kinds"), lambda e: only | ~F.array_contains(F.col("boiler"), e["evidence"]))
    return cand.select("doc_id", left["kinds"].alias("kinds")).where(F.size("kinds") > 0).groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"))
