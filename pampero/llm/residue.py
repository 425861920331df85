"""Template residue, filler and error-page text in documents."""

from __future__ import annotations

import html
import re
from functools import lru_cache

import pyarrow as pa

try:
    import ahocorasick
except ImportError:  # plain substring searches then
    ahocorasick = None
from pyspark.sql import Column, DataFrame, functions as F

_NAME = r"[A-Za-zÀ-ÿ_][\w.\-]{0,60}"
#: Slots by delimiter: each grammar takes a name, not any text, so line-ups, quotes and notes in the same delimiters stay out.
SLOTS = {
    "{{}}": rf"\{{\{{\s*{_NAME}(?:\s*[|:]\s*[\w .'\"-]{{1,40}})*\s*\}}\}}",
    "{%%}": r"\{%-?\s*[A-Za-z]\w*\b[^%{}\n]{0,80}%\}",
    "<%%>": r"<%[=-]?\s*[A-Za-z_@$][^%<>\n]{0,80}%>",
    "<??>": r"<\?(?:=|php\b)[^<>?\n]{0,80}\?>",
    "${}": rf"[$#]\{{\s*{_NAME}[^{{}}\n]{{0,40}}\}}",
    "[[]]": rf"\[\[\s*{_NAME}\s*\]\]",
    "@@": rf"@@\s?{_NAME}\s?@@",
    "__": r"(?<![\w])__[A-Za-zÀ-ÿ][\w.]{0,60}?__(?!\w)",
    "%%": r"(?<![\w%])%[A-Za-zÀ-ÿ_][A-Za-zÀ-ÿ_.]{1,60}%(?!\w)",
    "%()": rf"%\({_NAME}\)[sdifr]?",
    "%s": r"(?<![\w%])%[sd](?=[\s.,;:)\]»”]|$)",
    "{}": r"(?<![{$#\w])\{(?:[A-Za-zÀ-ÿ_][\w.]{0,60}|\d{1,2})\}(?!\})",
    "&lt;": r"&lt;[A-Za-zÀ-ÿ_][\w.]*_?[\w. ]{1,40}&gt;",
}
#: What stands in for content: capitals in brackets, requests to fill in, crossed-out words, a program's empty values.
STAND_INS = {
    "capitals": r"[\[<][A-ZÀ-Þ]{2,}(?:[ _][A-ZÀ-Þ]{2,}){1,6}[\]>]",
    "xxxx": r"(?<!\w)(?:[Xx]{2}/[Xx]{2}/[Xx]{2,4}|[Xx]{4,})(?!\w)",
    "empty": r"(?i:\[object object\])|(?<![\w-])(?:undefined|UNDEFINED|NaN|(?:null|NULL)(?! and void| hypothesis))(?![\w-])|#(?:REF!|N/A|VALUE!|NAME\?)|(?i:\binvalid date\b)",
}
REQUESTS = r"[\[<]\s*(?:insert\w*|inserir|insérer|inserer|completar|compl[ée]ter|rellenar|preencher|remplir|fill in|your|nombre (?:del?|completo)|nome d[oae]|nom d[ue]|player name|club name|team name|(?:date|name|title|fee|amount) tb[cd])\b[^\[\]<>\n\d]{0,50}[\]>]"
#: The same requests in quotes or round brackets count in capitals only: quotes also hold speech.
QUOTED = r"[«“\"‘(*_]\s*(?:INSERT\w*|INSERIR|INSÉRER|INSERER|COMPLETAR|COMPL[ÉE]TER|RELLENAR|PREENCHER|REMPLIR|FILL IN|NOMBRE (?:DEL?|COMPLETO)|NOME D[OAE]|NOM D[UE]|(?:PLAYER|CLUB|TEAM) NAME|(?:DATE|NAME|TITLE|FEE|AMOUNT) TB[CD])\b[A-ZÀ-Þ ]{0,50}[»”\"’)*_]"
#: Filler phrases (es, en, pt, fr).
FILLER = (
    r"\btext[oe]s? (?:de relleno|de ejemplo|de exemplo|de prueba|de muestra|de teste|simulado|à remplacer|a remplacer|d['’]exemple|de remplissage|provisoire)",
    r"\bp[aá]rr?[aá]gra?f?o de (?:muestra|ejemplo|relleno|prueba|exemplo|amostra)|\bp[aá]rrafo de (?:muestra|ejemplo|relleno|prueba)|\bparagraphe (?:d['’]exemple|de test)",
    r"\b(?:placeholder|dummy|sample|filler) (?:text|paragraph|copy|content|headline|article)",
    r"\b(?:body|lead|copy|headline|paragraph|caption|text)\b[^.\n]{0,24}\b(?:goes here|to come)\b|\(dummy\)",
    r"\bconte(?:nido|údo|udo|nu) (?:de prueba|pendiente|pendente|de teste|de test|à venir|a venir|provisional|provis[oó]rio|provisoire)",
    r"\baqu[ií] va (?:el|la) (?:cuerpo|texto|titular|noticia|entradilla)|\baqui (?:vai|entra) o (?:corpo|texto|título)|\bici le (?:corps|texte|titre)",
    r"\bTODO: ?\w|\breplace before (?:going live|publi)|\bdelete me\b|,? no publicar\b|\bnão publicar\b|\bne pas publier\b|\bdo not publish\b",
    r"\b(bla|asdf\w*|test|teste|prueba|foo|xxx+|qwerty|dummy|texto)(?:[\s,.]+\1){2,}\b|\bqwerty uiop\b",
    r"\b(text[oe]? (?:aqu[ií]|here|ici)|(?:aqu[ií]|here|ici) text[oe]?)(?:[\s,.]+\w+){0,1}(?:[\s,.]+\1)+",
)
#: The words of the classical filler (fixed values), without those that are common in the corpus' languages.
LATIN = "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum".split()
_LATIN_RUN = rf"(?i)\b(?:{'|'.join(LATIN)})(?:[\s,.;]+(?:{'|'.join(LATIN)}|ut|et|do|in|ad|ex|ea|eu|non|qui|id|est)\b){{4,}}"
#: Statements of error, access, maintenance and scripts-needed pages (es, en, pt, fr). They count by the share of the text they make up.
PAGES = (
    r"(?:enable|activate|turn on|activar|active|ative|ativar|activer|habilit\w+|requiere|requer|require[sd]?|exige|need)\b[^.\n]{0,40}\b(?:javascript|scripts?|scripting|cookies)",
    r"\b(?:javascript|scripts?|scripting|cookies)\b[^.\n]{0,60}\b(?:disabled|desactivad\w+|désactivés?|desactives?|bloque\w+|habilitad\w+|ligad\w+|turned on|switched on|enabled|activad\w+|activés?|require\w*|exig\w+)|(?:bloqueou|bloqué|bloqueó|blocked) [^.\n]{0,20}scripts?|\bactívelos y recargue|\bactivelos y recargue|checking your browser",
    r"^\W*(?:error |erro |erreur )?\d{3}\b[^.\n]{0,12}(?:not found|p[aá]gina no encontrada|p[aá]gina não encontrada|pagina nao encontrada|page introuvable|forbidden|bad gateway|unavailable|internal server error|gateway time)|\bpage not found|\bp[aá]gina (?:no|não|nao) encontrada|\bpage introuvable|can['’]t find that page|\b(?:error|erro|erreur) \d{3}\W*$",
    r"(?:noticia|notícia|página|pagina|page|content|contenido|conteúdo|fiche|ficha)\b[^.\n]{0,50}(?:no existe|não existe|nao existe|n['’]existe plus|doesn['’]t exist|fue retirada|foi removida|is gone|ya no est[aá] disponible|j[aá] n[aã]o est[aá] dispon|n['’]est plus disponible|no longer available)",
    r"temporarily unavailable|service unavailable|servi(?:ço|co|cio) (?:indispon[ií]vel|no disponible)|service indisponible|en mantenimiento|em manuten|under maintenance|en maintenance|(?:volvemos|back|voltamos|de retour) (?:en|in|em|dans) (?:unos|a few|breve|quelques)|tente mais tarde|r[ée]essayez plus tard|try again (?:shortly|later)|int[ée]ntelo m[aá]s tarde|vuelva a intentarlo|un instante después",
    r"(?:servidor|server|serveur|base de datos|base de dados|base de données|database|gateway)\b[^.\n]{0,30}(?:no responde|não responde|nao responde|ne répond|ne repond|not responding|did not answer)|timed out|tiempo de espera agotado|tempo (?:de espera )?(?:limite )?esgotado|d[ée]lai d['’]attente|internal error|error interno|erro interno|erreur interne|error inesperado|erro inesperado|erreur inattendue|unexpected error|something went wrong|algo sali[oó] mal|algo correu mal|un problème est survenu|un probleme est survenu",
    r"(?:no pudimos|could not|couldn['’]t|n[aã]o foi poss[ií]vel|impossible de)\b[^.\n]{0,20}(?:cargar|load|carregar|charger)|\bno podemos mostrar",
    r"access denied|acceso denegado|acesso negado|acc[èe]s (?:refus[ée]|interdit)|too many requests|request limit|l[ií]mite de (?:visitas|pedidos|solicitudes)|limite de (?:requêtes|requetes|visites)|direcci[oó]n ha sido bloqueada|endereço foi bloqueado|adresse a été bloquée|session (?:has expired|a expir)|sesi[oó]n ha caducado|sess[aã]o (?:expirou|terminou)|inicie sesi[oó]n|sign in again|reconnectez-vous",
)
#: Classes of words (es, en, pt, fr) that the grammars below are made of: what a page shows, what serves it, how it fails, who is kept out.
TEXTS = r"(?:text[oe]?s?|p[aá]rraf?os?|par[aá]grafos?|paragraph(?:e|s|es)?|conte(?:nts?|nidos?|[uú]dos?|nus?)|copy|cop(?:ies)|cuerpo|corpo|corps|body|t[ií]tul(?:os?|ar(?:es)?)|titres?|headlines?|captions?|entradillas?|art[ií](?:culos?|gos?)|articles?|not[ií]cias?|descripci[oó]n|descri[cç][aã]o|description|resumen|resumo|r[eé]sum[eé]|summary)"
PRETEND = r"(?:relleno|prueba|ejemplo|muestra|testes?|exemplo|amostra|exemple|essai|remplissage|enchimento|preenchimento|provisional|provis[oó]ri[oa]|provisoire|pendiente|pendente|simulad[oa]|fict[ií]ci[oa]|fictif|dummy|placeholder|sample|filler|mock|demo)"
HERE = r"(?:here|aqu[ií]|ici)"
PLACED = r"(?:goes|belongs|comes|to come|will be|va|vai|ir[aá]|fica|entra|vient|viendra|se coloca|se inserta)"
WRITE = r"(?:write|add|insert|enter|type|replace|put|escrib[ae]|añad[ae]|agreg(?:ue|a)|insert[ea]|introduzca|reemplace|sustituya|pon(?:ga)?|escreva|adicione|insira|coloque|substitua|[eé]crivez|ajoutez|ins[eé]rez|remplacez|saisissez|mettez)"
SERVED = r"(?:pages?|p[aá]ginas?|sites?|sitios?|website|webs?|portal|services?|servi[cç]i?os?|servers?|servidor(?:es)?|serveurs?|resources?|recursos?|ressources?|url|address|direcci[oó]n|endere[cç]o|adresse|content|contenido|conte[uú]do|contenu|files?|archivos?|arquivos?|fichiers?|application|aplicaci[oó]n|aplica[cç][aã]o|connection|conexi[oó]n|conex[aã]o|connexion|database|bases? de d(?:atos|ados|onn[eé]es)|banco de dados|host|gateway|not[ií]cias?|art[ií]culos?|artigos?|articles?|link|enlace|lien)"
FAILING = r"(?:not found|(?:is|are|was)(?:n['’]t| not) (?:found|working|available|here|responding)|(?:does|do)(?:n['’]t| not) exist|unavailable|unreachable|(?:is|are) (?:currently |temporarily )?(?:down|offline)|(?:can['’]?t|can ?not|could(?:n['’]t| not)) be (?:reached|displayed|found|loaded|shown|opened)|no longer (?:available|exists?|here)|has (?:moved|expired|been (?:moved|removed|deleted|disabled))|no (?:se (?:ha )?encontr\w+|existe|est[aá] disponible|responde|funciona)|(?:n[aã]o (?:foi encontrad[oa]|existe|est[aá] dispon[ií]vel|responde|funciona|p[oô]de ser))|introuvable|n['’]existe (?:pas|plus)|n['’](?:est|a) (?:pas|plus) (?:[eé]t[eé] )?(?:trouv[eé]e?|disponible|accessible)|indispon[ií]\w+|inaccessible|inaccesible|inacess[ií]vel|no disponible|fuera de (?:servicio|l[ií]nea)|fora do ar|hors (?:service|ligne)|ha (?:caducado|expirado|sido (?:movid|eliminad|retirad)[oa])|foi (?:movid|removid|eliminad|retirad)[oa]|a [eé]t[eé] (?:d[eé]plac|supprim|retir)[eé]e?)"
UNABLE = r"(?:error|fallo|falha|[eé]chec|erro|erreur|failed|failure|unable to|impossible (?:de|to)|no (?:se pudo|fue posible|podemos|pudimos)|n[aã]o (?:foi poss[ií]vel|conseguimos)|could(?:n['’]t| not)|can(?:['’]t|not| not)|we had trouble)"
SERVING = r"(?:connect\w*|load\w*|display\w*|establish\w*|process\w*|retriev\w*|conectar\w*|conexi[oó]n|conex[aã]o|connexion|connecter|cargar|mostrar|establecer|procesar|abrir|carregar|estabelecer|processar|exibir|afficher|charger|[eé]tablir|traiter|ouvrir)"
REASONS = r"(?:bad request|unauthorized|payment required|forbidden|not found|method not allowed|not acceptable|request time-?out|conflict|gone|too many requests|internal server error|not implemented|bad gateway|service unavailable|gateway time-?out)"
#: Filler by what is said of the text itself: each has to make up most of its sentence.
META = (
    rf"\b{TEXTS}(?: de| d['’]| do| da| du| à| for| as)?(?: un| una| um| uma| a)? ?{PRETEND}\b|\b{PRETEND} {TEXTS}\b",
    rf"\b{HERE}\b[^.\n]{{0,12}}\b{PLACED}\b[^.\n]{{0,12}}\b{TEXTS}\b|\b{TEXTS}\b[^.\n]{{0,20}}\b{PLACED}\b[^.\n]{{0,8}}\b{HERE}\b",
    rf"\b{WRITE}\b[^.\n]{{0,12}}\b{TEXTS}\b[^.\n]{{0,8}}\b{HERE}\b|\b{HERE}\b[^.\n]{{0,8}}\b{WRITE}\b[^.\n]{{0,12}}\b{TEXTS}\b|\b{WRITE}\b (?:this|your|the|este|esta|su|tu|o seu|a sua|seu|sua|ce|cette|votre) {PRETEND}? ?{TEXTS}\b",
)
#: Page statements by what fails, for whom, and how it is put.
FAILURES = (
    rf"\b{SERVED}\b[^.\n]*?\b{FAILING}|\b{FAILING}\b[^.\n]*?\b{SERVED}\b",
    rf"\b{UNABLE}\b[^.\n]*?\b{SERVING}\b",
    rf"\b[45]\d\d\b[^.\n]{{0,12}}\b{REASONS}|^\W*{REASONS}\W*$",
    r"(?:don['’]t|do not) have (?:permission|access|authori[sz]ation)|\bno tienes? (?:permisos?|acceso|autorizaci[oó]n)|\bn[aã]o tem (?:permiss[aã]o|acesso|autoriza[cç][aã]o)|\bn['’]avez pas (?:la permission|l['’]autorisation|acc[eè]s)|\b(?:have|has) been blocked\b|\bnot authori[sz]ed\b|\bno autorizado\b|\bn[aã]o autorizado\b|\bnon autoris[eé]e?\b",
    r"\b(?:log|sign) in (?:to|again|first)|\blogin required|\binici(?:e|a) sesi[oó]n|\b(?:fa[cç]a|inicie) (?:o )?(?:login|sess[aã]o)|\b(?:re)?connectez-vous|\bidentifiez-vous|\bsess(?:ion|[aã]o)\b[^.\n]*\b(?:expir\w+|terminou)|\bsesi[oó]n\b[^.\n]*\b(?:expir|caduc)\w+",
    r"\b(?:browser|navegador|navigateur)\b[^.\n]*\b(?:support\w*|soporta|suporta|compatible|compat[ií]vel|out of date|obsolet[oe]|d[eé]pass[eé]|human|humano|humain)|\bverif\w+[^.\n]*\b(?:human|humano|humain|robot)\b|\b(?:not a|n[aã]o [eé] um|no (?:es|eres) un|pas un) robot\b",
    r"\b(?:mantenimiento|manuten[cç][aã]o|maintenance)\b|\b(?:check back|try again|come back|vuelva a|vuelve a|int[eé]ntelo|int[eé]ntalo|tente (?:novamente|de novo|mais)|volte|(?:r[eé])?essayez|revenez)\b[^.\n]*\b(?:minutes?|minutos|later|shortly|soon|m[aá]s tarde|mais tarde|plus tard|instants?|instantes|momentos?|breve|de nuevo)\b",
    r"\bredirected you too many times|\b(?:critical|fatal|unknown) error\b|\berror (?:cr[ií]tico|fatal|desconocido)\b|\berro (?:cr[ií]tico|fatal|desconhecido)\b|\berreur (?:critique|fatale|inconnue)\b|\btook too long to respond|\btime(?:d)?[- ]?out\b",
)
#: What such pages carry besides: navigation, codes, signatures.
BOILERPLATE = r"(?i)\b(?:id|ref|ray|código|codigo|code|srv)\b[.:/ ]*[0-9a-f]{3,}|©[^\n]{0,30}|back to home|volver a la portada|voltar (?:à|a) capa|retour à l['’]accueil|inicio \| \w+ \| \w+|\b(?:oops|ups|vaya|lo sentimos|aviso|atenção|atencao|sorry|notice|avis|désolé|desole|attention)\b|\b[0-9a-f]{8}\b|\b[0-9]{3}\b|^\s*(?:error|erro|erreur)\b"

_TAG = re.compile(r"</?[A-Za-z!][^>]*>")
_CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|<(code|pre|script|style)\b[^>]*>.*?(?:</\1>|\Z)|(?<!`)`[^`\n]+`(?!`)|(?m:^(?:    |\t)[^\n]*(?:;|\{|\}|=>|\(\))\s*$)", re.S | re.I)
_URL = re.compile(r"(?i)\b(?:https?|ftp)://\S+|\bwww\.\S+")
_JSON = re.compile(r"\{\s*\"[^{}]*\}")
_TUTORIAL = re.compile(r"(?i)\b(?:template syntax|template engine|placeholders? (?:syntax|such as|like|named)|string formatting|format string|jinja|mustache|handlebars|liquid tags?|variables? (?:syntax|interpolation)|sintaxis de (?:las )?plantillas?|motor de plantillas|syntaxe des? (?:gabarits?|templates?)|sintaxe de (?:modelos|templates))\b")
_BOILER = re.compile(BOILERPLATE, re.M)
_SENTENCE = re.compile(r"[^.!?…\n]+[.!?…]*|\n")
_WORD = re.compile(r"\w+")
_NO_LETTER = re.compile(r"[\W\d_]+")


def required(pattern: str, flags: int = 0) -> list[list[frozenset]]:
    """What any match of a pattern holds: per alternative, sets of strings in folded case, of each of which there must be one.

    Read off the parsed pattern: what must follow each other is a set each, alternatives within
    are joined into one. An alternative that tells nothing has no sets.
    """
    c = re._constants

    def exact(op, av) -> list[str] | None:
        """All strings that one part stands for, if they are few."""
        if op is c.LITERAL:
            return [chr(av)]
        if op is c.IN and len(av) <= 8 and all(o is c.LITERAL for o, _ in av):
            return sorted({chr(v) for _, v in av})
        if op is c.SUBPATTERN:
            return sequence(av[3])
        if op is c.BRANCH:
            each = [sequence(b) for b in av[1]]
            return None if any(e is None for e in each) else sorted({x for e in each for x in e})
        if op in (c.MAX_REPEAT, c.MIN_REPEAT) and av[0] == av[1] <= 4:
            one = sequence(av[2])
            return many([one] * av[0]) if one else None
        return [""] if op is c.AT else None

    def many(parts: list[list[str]]) -> list[str] | None:
        out = [""]
        for p in parts:
            out = [x + y for x in out for y in p]
            if len(out) > 64:
                return None
        return out

    def sequence(tree) -> list[str] | None:
        parts = [exact(op, av) for op, av in tree]
        return None if any(p is None for p in parts) else many(parts)

    def best(sets: list[frozenset]) -> frozenset | None:
        return max(sets, key=lambda k: (min(len(x.strip()) for x in k), -len(k)), default=None)

    def sets_of(tree) -> list[frozenset]:
        out, run = [], [""]

        def close():
            nonlocal run
            if all(run):
                out.append(frozenset(x.casefold() for x in run))
            run = [""]

        for op, av in tree:
            here = exact(op, av)
            longer = many([run, here]) if here is not None else None
            if longer is not None:
                run = longer
                continue
            close()
            if here is not None:
                run = here
            elif op is c.SUBPATTERN:
                out += sets_of(av[3])
            elif op is c.BRANCH:
                each = [best(sets_of(b)) for b in av[1]]
                if all(each):
                    out.append(frozenset().union(*each))
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT) and av[0] > 0:
                one = sequence(av[2])
                run = (many([one] * min(av[0], 4)) if one else None) or [""]
                close()
                if not one:
                    out += sets_of(av[2])
        close()
        return out

    def whole(tree) -> list[list[frozenset]]:
        if len(tree) == 1 and tree[0][0] is c.BRANCH:
            return [x for b in tree[0][1][1] for x in whole(b)]
        if len(tree) == 1 and tree[0][0] is c.SUBPATTERN:
            return whole(tree[0][1][3])
        return [sets_of(tree)]

    return whole(re._parser.parse(pattern, flags))


class Sieve:
    """Which of many patterns a text may match, by the strings that they require: one pass over the text however many patterns there are."""

    def __init__(self, patterns: list[str]):
        self.ways: list[list[int]] = []
        bits: dict[str, int] = {}
        n = 0
        for p in patterns:
            ways = []
            for sets in required(p, re.I):
                need = 0
                for one in sets:
                    for k in one:
                        bits[k] = bits.get(k, 0) | 1 << n
                    need |= 1 << n
                    n += 1
                ways.append(need)
            self.ways.append(ways)
        self.bits = bits
        self.machine = None
        if ahocorasick is not None:
            self.machine = ahocorasick.Automaton()
            for k, v in bits.items():
                self.machine.add_word(k, v)
            self.machine.make_automaton()

    def passes(self, low: str) -> tuple[int, ...]:
        """The numbers of the patterns that a text in folded case may match."""
        there = 0
        if self.machine is not None:
            for v in {v for _, v in self.machine.iter(low)}:
                there |= v
        else:
            for k, v in self.bits.items():
                if k in low:
                    there |= v
        return tuple(i for i, ways in enumerate(self.ways) if any(there & need == need for need in ways))


def low_of(text: str) -> str:
    """A text in folded case, with the letters that case-blind patterns take for others in one form."""
    low = text.casefold()
    return low if low.isascii() else low.replace("ı", "i").replace("i̇", "i")


#: Every grammar by what it tells; a text is searched for those that it may match.
GRAMMARS = [
    *(("slot", p) for p in (*SLOTS.values(), *STAND_INS.values(), f"(?i:{REQUESTS})", QUOTED)),
    *(("filler", f"(?i:{p})") for p in FILLER),
    ("latin", _LATIN_RUN[4:]),
    *(("meta", f"(?i:{p})") for p in META),
    *(("page", f"(?im:{p})") for p in (*PAGES, *FAILURES)),
]
_SIEVE = Sieve([p for _, p in GRAMMARS])


@lru_cache(8192)
def _joined(numbers: tuple[int, ...], kind: str) -> re.Pattern | None:
    """The grammars of a kind among some as one pattern; those that take a word up again stand alone."""
    mine = [GRAMMARS[i][1] for i in numbers if GRAMMARS[i][0] == kind]
    return re.compile("|".join(f"(?:{p})" for p in mine), re.I if kind == "latin" else 0) if mine else None


@lru_cache(8192)
def _single(numbers: tuple[int, ...], kind: str) -> tuple[re.Pattern, ...]:
    return tuple(re.compile(GRAMMARS[i][1]) for i in numbers if GRAMMARS[i][0] == kind)


def letters(text: str) -> int:
    return len(_NO_LETTER.sub("", text))


def repeats(text: str, share: float = 0.6, longest: int = 4, times: int = 4) -> bool:
    """Whether one unit of up to ``longest`` words, said ``times`` or more times in a row, makes up a share of a text, whatever its words."""
    ws = _WORD.findall(text.casefold())
    n = len(ws)
    # said four times, a unit has at most a quarter of the run's words
    if n < times or len(set(ws)) > (1 - share) * n + n / times:
        return False
    for k in range(1, longest + 1):
        run = 0
        for i in range(k, n + 1):
            if i < n and ws[i] == ws[i - k]:
                run += 1
                continue
            if run >= (times - 1) * k and run + k >= share * n:
                return True
            run = 0
    return False


def about_itself(text: str, meta: re.Pattern) -> bool:
    """Whether a sentence is, for the most part, a statement that the text is none yet."""
    if not meta.search(text):
        return False
    for m in _SENTENCE.finditer(text):
        hit = meta.search(m[0])
        if hit and letters(hit[0]) >= 0.5 * letters(m[0]):
            return True
    return False


def page_statements(plain: str, statements: re.Pattern, share: float) -> bool:
    """Whether page statements make up a share of a text's own letters; navigation, codes and signatures are not its own.

    Ends once the sentences that state nothing outweigh what may be left.
    """
    most = (1 - share) * letters(plain)
    said = unsaid = 0
    for m in _SENTENCE.finditer(plain):
        own = letters(_BOILER.sub("", m[0]))
        if not own:
            continue
        if statements.search(m[0].strip()):
            said += own
        else:
            unsaid += own
            if unsaid > most:
                return False
    return said > 0 and said >= share * (said + unsaid)


def reasons(text: str | None, tutorial_share: float = 0.2, page_share: float = 0.6) -> list[str]:
    """Why a text is residue: ``slot``, ``filler`` and/or ``page``; [] for clean, blank, empty and null texts.

    A slot must stand outside code blocks, inline code, URLs and JSON objects, which are set aside. A text
    that speaks about templates (see ``_TUTORIAL``) is read as a tutorial: its slots count only
    from a density of ``tutorial_share`` a word on. Filler are known phrases, sentences made up of
    a statement that the text is none yet, classical filler words, and one short unit repeated
    over most of a text. A page is one whose own words, without navigation and codes, are made up
    to ``page_share`` or more of page statements; a sentence about errors in an article is a small
    share and never counts. Before each set of grammars the strings that its patterns require are
    looked for; these follow from the patterns, so no match is lost.
    """
    if not text or not text.strip():
        return []
    out, may = [], _SIEVE.passes(low_of(text))
    slot = _joined(may, "slot")
    if slot and slot.search(text):
        body = _JSON.sub(" ", _URL.sub(" ", _CODE.sub(" ", text)))
        hits = sum(1 for _ in slot.finditer(body))
        if hits and not (_TUTORIAL.search(text) and hits < tutorial_share * len(text.split())):
            out.append("slot")
    latin, meta = _joined(may, "latin"), _joined(may, "meta")
    if (
        any(p.search(text) for p in _single(may, "filler"))
        or latin and any(len({w for w in _WORD.findall(m[0].casefold()) if w in _LATIN_WORDS}) >= 3 for m in latin.finditer(text))
        or meta and about_itself(text, meta)
        or repeats(text)
    ):
        out.append("filler")
    plain = text
    if "&" in text or "<" in text:
        plain = _TAG.sub("\n", html.unescape(text))
        may = _SIEVE.passes(low_of(plain))
    page = _joined(may, "page")
    if page and page_statements(plain, page, page_share):
        out.append("page")
    return out


_LATIN_WORDS = frozenset(LATIN)


def residue(df: DataFrame, key: str, text: str, page_share: float = 0.6) -> DataFrame:
    """``key`` and ``motivos`` (array<string>) of each text with residue; one pass, no shuffle.

    Null, blank and empty texts never come out. Whole texts are read, however long. Repeated rows
    come out as often as they stand; other columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            keys, found = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                why = reasons(t, page_share=page_share)
                if why:
                    keys.append(i)
                    found.append(why)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(found, pa.list_(pa.string()))], names=[key, "motivos"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, motivos array<string>")
