"""Problem 10: template residue and text of failed page loads in place of content.

One multi-pattern automaton holds word stems of several languages, each standing
for a notion: something went wrong, a page or its parts, what one does with a
page, advice to the reader, scripts, switching on, a placeholder. A sentence is a
message if its notions go together (a fault and a page; scripts and switching on;
two pieces of advice; a placeholder's mark and a part of a text) and cover most of
its words that aren't function words; so wording that was never listed is found,
while a sentence that talks about an error in words of its own is not. Unfilled
fields are found by their delimiters, filler by the classic filler text, runs of
keys and repeated words.

Coverage is taken per sentence: a residue paragraph makes the document a case
however long it is. Reported coverage is that of the whole document.

Whole texts are read, row by row in Arrow batches; nothing is shuffled but the
rows found.

Defined results: null and empty texts are no residue; a text without sentence
ends is one sentence; null ids are left out; a document stored several times
comes out once; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Stems by notion and language; a stem stands for every word that begins with it, one with a final stop for itself only.
FAULT = {
    "en": "error fail fault. wrong. invalid forbidden. denied. refused. rejected. unauthori unavailable. unreachable. inaccessible. overload expired. timeout. timeouts. timed. exhausted. exception. traceback. fatal. broken. missing. offline. maintenance. outage. crash oops. sorry. unable. cannot. can't. couldn. cant. could_not could_n_t can_not not_found no_longer does_not do_not don_t not_exist bad. temporar too_many moved. interrupted_connection aborted. unexpected. not_available no_results not_permitted not_allowed not_authori lack_permission lack_the_permission time_out request_id incident_id error_id",
    "de": "fehler nicht. kein. keine. abgelehnt unterbrochen überschritten verweigert ungültig abgelaufen nicht_gefunden leider. überlastet zeitüberschreitung gesperrt wartung",
    "fr": "erreur introuvable refusé interdit expiré indisponible impossible. échec désolé inaccessible. n_existe n_a_pas ne_peut",
    "es": "error fallo no_responde no_está no_disponible denegad prohibid caducad expirad encontrada encontrado encontrar no_se no_existe no_encontr disponible. lo_sentimos mantenimiento",
    "it": "errore negato vietato scadut impossibile. non_trovat non_esiste non_è disponibile. spiacenti manutenzione",
    "pt": "erro falha não_existe não_está não_responde não_pode negado proibid expirou expirad não_encontrad não_existe não_foi indisponível desculpe. manutenção",
    "nl": "fout niet. kan_niet kon_niet geweigerd verlopen niet_gevonden niet_beschikbaar helaas. bestaat_niet storing onderhoud",
    "sv": "fel. felet. nekad hittades_inte inte. tyvärr. saknas. underhåll",
    "da": "fejl nægtet ikke. ikke_fundet desværre. findes_ikke udløbet vedligehold",
    "no": "feil. feilet. nektet ikke_funnet dessverre. finnes_ikke",
    "fi": "virhe. virheen. ei. löytynyt löydy. estetty valitettavasti. vanhentunut",
    "pl": "błąd błędu. odmowa. nie. nie_istnieje znaleziono znaleziona wygasł niedostępn niestety. przerwa_techniczna",
    "cs": "chyba. nebyla_nalezena nebyl_nalezen nenalezen neexistuje. odepřen bohužel. nedostupn",
    "tr": "hata. bulunamadı. reddedildi. geçersiz",
    "ru": "ошибк найден запрещ отказано. недоступ истекл истёк не_найден не_существует невозможно. извините. техническ",
}
PAGE = {
    "en": "page pages. document file files. url urls. link links. site sites. website web. resource article content record records. server service host. gateway address. request pdf. repository session connection upstream. application app. database full_text text. view. viewer. reader http https status. code. codes. id. reference. proxy. network. internal. module. line. memory. port. item. entry. end. remote. key keyerror. function. call. recent. last. script_error issue. site_administrator administrator. account. module. process",
    "de": "seite dokument datei inhalt adresse server verbindung anfrage zugriff sitzung dienst interner.",
    "fr": "page fichier contenu adresse. serveur accès requête session service interne. ressource",
    "es": "página archivo contenido dirección servidor acceso solicitud sesión servicio interno. recurso",
    "it": "pagina contenuto indirizzo. server. accesso richiesta sessione servizio interno. risorsa",
    "pt": "página arquivo conteúdo endereço servidor acesso pedido sessão serviço interno. recurso",
    "nl": "pagina bestand inhoud adres. server. toegang verzoek sessie dienst",
    "sv": "sida. sidan. innehåll server. servern. åtkomst begäran tjänsten.",
    "da": "side. siden. indhold serveren. adgang tjenesten. anmodning",
    "no": "side. siden. innhold tilgang tjenesten.",
    "fi": "sivu. sivua. sivun. sivusto palvelin palvelimen. sisältö pääsy",
    "pl": "strona. strony. plik. treść serwer dostęp żądanie sesja usługa",
    "cs": "stránka stránku. obsah server. přístup",
    "tr": "sayfa sunucu erişim içerik",
    "ru": "страниц файл документ сервер доступ сесси запрос содержим сайт внутренн",
}
ACT = {
    "en": "load. loads. loading. loaded. display displayed. open. opened. find. found. locate. located. retrieve retrieved. show. shown. reach. reached. connect connected. access. accessing. fetch. fetched. exist exists. permission. permitted. allowed. requested. requesting. respond responding. occurred. happened. render. rendered. looking. went. process. processed. complete. completed. served. removed. deleted. available. returned. time. at_this right_now currently. over. out. down. handle. allocate allocated. blocked. limit. exceeded.",
    "de": "geladen. gefunden. angezeigt. geöffnet. angeforderte angefordert aufgetreten. existiert werden. wurde. konnte.",
    "fr": "charg affich ouvr demandé survenue. trouvé atteindre existe.",
    "es": "busca. buscada. cargar. mostrar. abrir. solicitad producido. existe. cargado. pudo.",
    "it": "caricare. caricat mostrare. aprire. richiest verificato. esiste. trovat stato.",
    "pt": "procura. procurada. carregar. carregad mostrar. abrir. solicitad ocorreu. existe. foi. possível.",
    "nl": "geladen. gevonden. weergegeven. geopend. opgetreden. kon.",
    "sv": "hittas. hittades. laddas. visas. inträffade. kunde.",
    "da": "fundet. findes. indlæses. vises. opstod. kunne. opstået.",
    "no": "funnet. finnes. lastes. vises. oppstod. kunne.",
    "fi": "ladata. ladattu. näyttää. tapahtui. voitu. olemassa.",
    "pl": "podanym. adresie. załadować. wyświetlić. wystąpił została. żądana.",
    "cs": "načíst. zobrazit. došlo.",
    "tr": "yüklenemedi. oluştu.",
    "ru": "запрашива загруз отобра открыт произошл существует. запрошенн",
}
ADVICE = {
    "en": "try_again again. retry retrying. later. please. contact. support. administrator. webmaster. persists. persist. problem. refresh reload return. returning. back. go. home. homepage. start. start_page help. check. verify. menu. browse browsing. navigate search. log sign. login. wait. seconds. second. minutes. minute. hour. hours. tomorrow. soon. come. moment. apologi inconvenience. previous. continue. proceed. register. subscribe. use. click. visit. shortly. scheduled. few.",
    "de": "bitte. noch. einmal. später. erneut. wieder. versuchen. versuche. zurück. startseite. anmelden. prüfen. kontaktieren. minuten.",
    "fr": "veuillez. réessay plus_tard retour. accueil. vérifi saisie. connect contacte plus. tard.",
    "es": "por_favor inténtel intentarlo. intentar. vuelva. intente. más_tarde inicio. verifique. regres más. tarde. nuevo. volver.",
    "it": "riprova. torna. più_tardi iniziale. verifica. home. più. tardi. riprovare.",
    "pt": "tente. novamente. mais_tarde voltar. início. verifique. mais. tarde.",
    "nl": "probeer. opnieuw. later. terug. startpagina. controleer.",
    "sv": "försök. igen. senare. tillbaka. startsidan. kontrollera.",
    "da": "prøv. igen. senere. tilbage. forsiden. venligst. kontroller.",
    "no": "prøv. igjen. senere. tilbake. forsiden. vennligst.",
    "fi": "yritä. uudelleen. myöhemmin. takaisin. etusivulle. tarkista.",
    "pl": "spróbuj. ponownie. później. wróć. główna. proszę.",
    "cs": "zkuste. znovu. později. zpět. prosím.",
    "tr": "lütfen. tekrar. sonra. deneyin. geri. ana.",
    "ru": "попробуйте. повторите. позже. вернуться. вернитесь. главную. пожалуйста. попытку. проверьте.",
}
SCRIPT = {"en": "javascript scripts. script. scripting noscript cookies. cookie. captcha browser client_side human. robot. bot. bots. ad_blocker adblock", "xx": "skript. skripte navegador navigateur navegator selain webbläsare nettleser przeglądark prohlížeč tarayıc браузер скрипт"}
SWITCH = {
    "en": "enable enabled. enabling. activate activated. turn. turned. switch switched. allow. allowed. support supported. supports. require requires. required. disabled. disable. blocked. need. needs. not. on. run. running. work. works. without. nothing. appears. verify. confirm. complete. prove. checking. check. security. depends. must. off. full. see. order. before. accessing. site. proceed.",
    "de": "aktivieren. aktiviert. deaktiviert einschalten. benötigt. erforderlich. anzuzeigen. um. den. inhalt.",
    "fr": "activez. activer. désactivé requis. afficher. cette.",
    "es": "active. activar. activa. habilite. habilitar. desactivado. requiere. ver. contenido.",
    "it": "attiva. attivare. abilita. abilitare. disattivato. visualizzare. richiede.",
    "pt": "ative. ativar. habilite. desativado. requer. ver.",
    "nl": "schakel. inschakelen. uitgeschakeld. vereist. weer. geven. te.",
    "sv": "aktivera. aktiverat. slå. på. inaktiverat. kräver. visa.",
    "da": "aktiver. aktivér. aktivere. slå. til. deaktiveret. kræver. se. vise.",
    "no": "aktiver. aktivere. slå. på. deaktivert. krever. se. vise.",
    "fi": "ota. käyttöön. salli. poistettu. vaatii. nähdäksesi.",
    "pl": "włącz. włączyć. wyłączona. wymaga.",
    "cs": "povolte. zapněte. vypnut. vyžaduje.",
    "tr": "etkinleştirin. açın. devre. gerekli.",
    "ru": "включите. включить. необходимо. нужно. работы. сайта. отключен требуется. разрешите. просмотр просмотреть.",
}
#: Marks that alone tell a placeholder, and those that need another one.
HOLDER = {"en": "placeholder dummy. dummy_text goes_here coming_soon under_construction to_be_added to_be_written to_be_completed to_be_determined to_be_announced to_be_inserted will_follow will_be_added will_be_written will_be_inserted", "xx": "blindtext platzhalter remplissage. relleno. segnaposto. plaatshouder platshållare pladsholder plassholder paikkamerkki заполнитель заглушка hier_steht steht_hier texto_de_ejemplo texto_de_exemplo testo_di_esempio texte_d_exemple exempeltext eksempeltekst"}
HINT = {
    "en": "here. replace. insert. type. enter. add. write. put. your. own. something. sample. example. filler. layout. purposes. only. soon. later. goes. go. edit. change. real. temporary. demo.",
    "xx": "hier. hierhin. ihr. ihren. später. steht. kommt. einfügen. ersetzen. ici. votre. remplacer. insérer. aquí. aqui. su. seu. sin. ejemplo. exemplo. exemple. esempio. qui. inserire. inserisci. här. her. din. ersätt. erstatt здесь. будет. ваш. вставьте.",
}
PART = {"en": "text. texts. paragraph summary abstract. content section sections. block title. description caption heading body. page. chapter. article. headline. sentence number. data.", "xx": "absatz. zusammenfassung inhalt. titel. texte. paragraphe résumé. contenu. titre. texto. párrafo resumen. contenido. título. testo. paragrafo. titolo. parágrafo resumo conteúdo tekst. text_en текст абзац"}
# The same notions in scripts that put no space between words.
UNSPACED = {
    "fault": "错误 不存在 找不到 未找到 无法 被拒绝 失败 超时 过期 不可用 エラー 見つかりません 拒否 失敗 できません 오류 없습니다 거부",
    "page": "页面 服务器 访问 文件 内部 请求 网页 ページ サーバー アクセス ファイル 페이지 서버",
    "act": "您访问的 发生 加载 显示 打开 載入 表示 発生",
    "advice": "请稍后 再试 重试 返回 首页 稍后 再試 後で もう一度 戻る 다시",
    "script": "脚本 浏览器 スクリプト ブラウザ",
    "switch": "启用 开启 不支持 有効 にして ください 활성화",
    "holder": "占位 此处 示例文字 ダミーテキスト",
    "hint": "填写 输入 插入 入力",
    "part": "文字 内容 文本 テキスト",
}
# Function words, which neither cover nor need cover.
NEUTRAL = frozenset(
    "a an the this that these those it its is are was were be been being to of for in on at by with from and or if as not no we you i he she they our us me my which who whom when while until there what where has have had will would may might can could should must do does did so then than too very just also any some all one only into about up out off over under again more most other after before because now but re ve ll while there their "
    "der die das den dem des ein eine einen einem einer und oder ist sind war wird von zu zum zur im in mit auf für es sich um diese dieser dieses sie wir ihr bitte derzeit momentan zurzeit aber dass wenn an bei nach le la les un une des du de et ou est sont à au aux ce cette en dans sur pour que qui il elle l d el los las uno y o es son al del lo se su por para con una che di il gli e per con non si da os as um uma e é são ao do da dos das no na nos nas em "
    "het een en van is op te dat voor met niet deze dit tot naar maar kan ett och är att på som för av til og er at det den i på af om se ja on w z na do się i o для на и в не с по это что".split()
)
# Fixed value: the classic filler text.
LOREM = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco
laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident
sunt culpa qui officia deserunt mollit anim id est laborum urna cras pellentesque egestas semper gravida nibh lectus mattis ornare tincidunt porta vivamus aenean donec nunc integer
vestibulum mauris viverra ultrices faucibus feugiat
"""
KEY_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")

NAME = r"[^\W\d_][\w.]"
FIELD = re.compile(
    rf"\{{\{{\s*[\w .-]+\}}\}}|\$\{{\s*[\w.-]+\s*\}}|<<\s*[\w .-]+>>|\[\[\s*[\w .-]+\]\]|@@[\w.]+@@|__[A-Za-z](?:(?!__)[\w.])*__|%{NAME}+%|#{NAME}+#|\bXX_[\w.]+_XX\b|::{NAME}+::|\*\|[\w.]+\|\*|<%=?\s*[\w. -]+%>|\{{%\s*[\w. -]+%\}}"
    rf"|(?:<|&lt;)\s*(?:insert\s+|your\s+|enter\s+)?{NAME}{{2,}}(?:[ _-]{NAME}*)?\s*(?:>|&gt;)|\[\s*(?:todo:?\s*|tbd:?\s*|insert\s+|your\s+|enter\s+)?{NAME}{{2,}}(?:\s+here)?\s*\]|\[\s*(?:insert|your|enter|todo|tbd)\b[\w :'-]*\]|\[[A-Z][A-Z_]+(?:\s[A-Z_]+)*\]|\{{\s*{NAME}{{2,}}\s*\}}",
    re.I,
)
DELIMITER = re.compile(r"[{}\[\]<>@_%#*]|::|&lt;")
CODE = re.compile(r"\b[45]\d\d\b")
CAPITALS = re.compile(r"\[[A-Z][A-Z_ ]+\]")
SENTENCES = re.compile(r"(?<=[.!?…。！？])\s+|(?<=[。！？])|\s*[\n\r]+\s*")
NOT_LETTER = re.compile(r"[\W\d_]+")
UNSPACED_LETTER = re.compile(r"[぀-ヿ一-鿿가-힯]")
QUOTED = re.compile(r"[\"“«„][^\"“”«»„\n]+[\"”»“]")
REPEATED = re.compile(r"(?<!\S)(\w+)(?: \1){2,}(?!\S)")
KEY_RUN = re.compile(r"(?<!\S)(?:([^\W\d_])\1+|(?:asdf|sdfg|qwer|wert|zxcv|xcvb|hjkl|jkl)\w*)(?!\S)")
COVER = 0.8
FIELD_SHARE = 0.25
FILLER_SHARE = 0.6


def _norm(text: str) -> str:
    return NOT_LETTER.sub(" ", text.lower()).strip()


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """All stems; the value is (notions, length, whether the word must end there, whether it stands without spaces)."""
    table: dict[tuple[str, bool], set[str]] = {}
    named = {"fault": FAULT, "page": PAGE, "act": ACT, "advice": ADVICE, "script": SCRIPT, "switch": SWITCH, "holder": HOLDER, "hint": HINT, "part": PART}
    for notion, by_language in named.items():
        for block in by_language.values():
            for stem in block.split():
                table.setdefault((_norm(stem.rstrip(".").replace("_", " ").replace("'", " ")), stem.endswith(".")), set()).add(notion)
    a = ahocorasick.Automaton()
    merged: dict[str, list] = {}
    for (stem, ends), notions in table.items():
        merged.setdefault(f" {stem}", []).append((frozenset(notions), len(stem) + 1, ends, False))
    for notion, block in UNSPACED.items():
        for s in block.split():
            merged.setdefault(s, []).append((frozenset([notion]), len(s), False, True))
    for w in LOREM.split():
        for k in range(min(5, len(w)), len(w) + 1):  # also cut off, from five letters on
            merged.setdefault(f" {w[:k]}", []).append((frozenset(["lorem"]), k + 1, True, False))
    for key, values in merged.items():
        a.add_word(key, tuple(values))
    a.make_automaton()
    return a


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    """The words of which a message or filler holds one, faults, advice, scripts and marks of placeholders."""
    a = ahocorasick.Automaton()
    for key, values in automaton().items():
        for kinds, _, whole, _ in values:
            if kinds & {"fault", "advice", "script", "holder", "hint"} or ("lorem" in kinds and len(key) > 4):
                a.add_word(f"{key} " if whole else key, 1)
    a.make_automaton()
    return a


def _length(text: str) -> int:
    return len(text) - text.count(" ")


def notions(norm: str) -> tuple[dict[str, int], int, int]:
    """(letters by notion, letters covered by any of them, letters that need cover) of a normalised sentence."""
    padded = f" {norm} "
    best: dict[int, tuple[int, frozenset]] = {}  # by first letter: end of the longest stem there
    for end, values in automaton().iter(padded):
        for kinds, n, whole, unspaced in values:
            s, e = (end - n + 1, end + 1) if unspaced else (end - n + 2, end + 1)
            if not unspaced and padded[e] != " ":
                if whole:
                    continue
                e = padded.index(" ", e)
            old = best.get(s)
            if old is None or e > old[0]:
                best[s] = (e, kinds)
            elif e == old[0]:
                best[s] = (e, old[1] | kinds)
    letters: dict[str, int] = {}
    covered, at = 0, 0
    spans = []
    for s in sorted(best):
        e, kinds = best[s]
        if s < at:
            continue
        n = _length(padded[s:e])
        covered += n
        for k in kinds:
            letters[k] = letters.get(k, 0) + 1
        spans.append((s, e))
        at = e
    need, i = covered, 0
    rest = []
    for s, e in spans:
        rest.append(padded[i:s])
        i = e
    rest.append(padded[i:])
    for w in " ".join(rest).split():
        if w not in NEUTRAL and len(w) > 1:
            need += len(w)
    return letters, covered, need


def _is_message(norm: str, codes: int) -> bool:
    """Whether a sentence says that a page failed, that scripts are needed, or that text is still to come."""
    n, covered, need = notions(norm)
    if covered < COVER * need:
        return False
    has = lambda k: n.get(k, 0)
    words = norm.count(" ") + 1
    return bool(
        (has("fault") and (has("page") or has("act") or has("advice") or codes))
        or (has("fault") and words <= 3)
        or (has("script") and (has("switch") or has("fault") or has("advice")))
        or has("advice") >= 2
        or (has("holder") and words <= 12)
        or (has("hint") and has("hint") + has("part") >= 3 and has("part"))
        or (has("page") >= 2 and codes and words <= 4)
        or (has("switch") >= 2 and has("page") and words <= 7 and n.get("advice", 0) + n.get("act", 0) > 0 and norm.startswith(("turn ", "enable ", "activate ", "switch ")))
    )


def _key_run(w: str) -> bool:
    """Whether a word is one letter repeated or neighbours on a keyboard."""
    return len(w) >= 2 and (len(set(w)) == 1 or len(w) >= 3 and any(w in r for r in KEY_ROWS))


def _filler_share(norm: str, runs: bool) -> float:
    """Share of a sentence's letters in classic filler, runs of keys and words said over and over."""
    spans = []
    padded = f" {norm} "
    for end, values in automaton().iter(padded):
        for kinds, n, _, unspaced in values:
            if "lorem" in kinds and not unspaced and padded[end + 1] == " ":
                spans.append((end - n + 2, end + 1))
    if runs:
        at = 0
        for w in norm.split(" "):
            if _key_run(w):
                spans.append((at + 1, at + 1 + len(w)))
            at += len(w) + 1
        spans += [(m.start() + 1, m.end() + 1) for m in REPEATED.finditer(norm)]
    if not spans:
        return 0.0
    total, end = 0, 0
    for s, e in sorted(spans):
        if e > end:
            total += _length(padded[max(s, end) : e])
            end = e
    return total / max(1, _length(norm))


def _covered(spans: list[tuple[int, int]]) -> int:
    total, end = 0, 0
    for s, e in sorted(spans):
        if e > end:
            total += e - max(s, end)
            end = e
    return total


def _dense(spans: list[tuple[int, int]], text: str) -> bool:
    """Whether some field is followed by another almost at once: a sentence without an end may run on into content."""
    return any(b[0] - a[1] <= 4 and "(" not in text[a[1] : b[0]] for a, b in zip(spans, spans[1:], strict=False))


def _fields(sentence: str) -> list[tuple[int, int]]:
    plain = QUOTED.sub(lambda m: " " * len(m.group()), sentence)
    return [m.span() for m in FIELD.finditer(plain) if " " not in m.group().strip("[]") or not m.group().startswith("[") or m.group().startswith("[[") or CAPITALS.fullmatch(m.group()) or re.match(r"(?i)\[\s*(?:insert|your|enter|todo|tbd)\b|\[\s*\S+\s+here\s*\]|\[\s*\S+\s*\]", m.group())]


def judge(text: str | None) -> tuple[str | None, float]:
    """(kind of residue or None, share of the document's length in residue sentences)."""
    if not text or not text.strip():
        return None, 0.0
    runs = KEY_RUN.search(text.lower()) is not None or REPEATED.search(_norm(text)) is not None
    kind, bad, total = None, 0, 0
    for s in SENTENCES.split(text):
        if not s.strip():
            continue
        total += len(s)
        found = judge_sentence(s, runs)
        if found:
            kind = kind or found
            bad += len(s)
    return kind, bad / max(1, total)


def judge_sentence(s: str, runs: bool = True) -> str | None:
    """Kind of residue that a sentence is; ``runs`` tells whether its document has runs of keys or repeated words."""
    if DELIMITER.search(s):
        fields = _fields(s)
        if fields and (_covered(fields) >= FIELD_SHARE * len(s.strip()) or _dense(fields, s)):
            return "template"
    norm = _norm(s)
    if not norm:
        return None
    anchored = next(anchors().iter(f" {norm} "), None) is not None
    if anchored and _is_message(norm, len(CODE.findall(s))):
        return "message"
    if (anchored or runs) and norm.count(" ") >= 2:
        if _filler_share(norm, runs) >= FILLER_SHARE:
            return "filler"
        if runs:  # filler that runs on into a message
            lead = [w for w in REPEATED.sub(" ", norm).split() if not _key_run(w)]
            if lead and len(lead) < norm.count(" ") + 1 and _is_message(" ".join(lead), 0):
                return "message"
    return None


def residue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, kind, coverage): one row per document with residue; kind is template, message or filler."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            got = [judge(t) for t in pdf["text"]]
            out = pd.DataFrame({"id": pdf["id"], "kind": [g[0] for g in got], "coverage": [g[1] for g in got]})
            yield out[out["kind"].notna()]

    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    got = rows.mapInPandas(scan, f"id {id_type}, kind string, coverage double")
    return got.groupBy("id").agg(F.max_by("kind", "coverage").alias("kind"), F.max("coverage").alias("coverage")).select(F.col("id").alias(id_col), "kind", "coverage")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold residue; rows with a null id are kept."""
    return docs.join(residue(docs, id_col, text_col).select(id_col), id_col, "left_anti")


def found(docs: DataFrame) -> DataFrame:
    """(doc_id)."""
    return residue(docs).select("doc_id")
