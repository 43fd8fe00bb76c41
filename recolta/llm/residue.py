"""Template residue, filler and error-page text (problem 4).

A positive-unlabelled naive Bayes learns from trusted records (wordings of servers, script notices,
fillers and placeholder syntax that are public and the same everywhere, below) against all
passages of the table, by expectation-maximization: unlabelled passages begin as
negative and get the probability that the last model gives them. No passage is evidence about itself: its
own share is taken out of the counts that judge it, else a wording that only the table holds would
stay negative for good. Every passage of every text is then
scored, and a record is a case if one of its passages is: residue stands for the post or in it.

The executors count every passage and feature. A few passages need the rounds of EM: of the others each has, by the
last model, a probability below that of LEAST_SCORE, which counts as none; they are judged again until no other needs them.

A passage is a sentence or line. Its features are words, pairs of neighbouring words, and kinds of
token: a placeholder of any syntax, a number, a file path or tag. What people write *about* errors,
templates or scripts stays, since its other words are those of ordinary passages.

Defined cases: null, empty and blank texts are no cases; an empty table trains on the trusted
records and built-in sentences only; long texts are scored passage by passage to
their end; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from recolta.llm.plain_text import SENTENCES
from recolta.llm.visual_form import fold
from recolta.session import materialize

#: Texts of the tables that margins and limits were chosen on. In a larger table a passage counts as often as it is in so many texts on
#: average, beside the trusted ones, whose number is fixed and which would lose their say with the table's size otherwise.
SAMPLE_TEXTS = 12_000
#: Characters of a unit that is counted: longer texts are cut into units, so that no row is long.
SAMPLE_UNIT = 5_000
#: Rounds of EM, and passages up to which the driver alone does them.
ROUNDS, DRIVER_PASSAGES = 10, 40_000
#: Score below which a passage's probability counts as none, and log-odds below which a feature has none.
LEAST_SCORE, LEAST_WEIGHT = -9.0, 0.05
#: Greatest share of residue among passages that is assumed beforehand.
MOST_RESIDUE = 0.05
#: Log-odds from which a passage is residue.
LEAST_ODDS = 0.0
#: Further log-odds that a part of a passage needs, a passage of one or two words that is not trusted, and any passage that
#: is judged by what is known apart from it.
PART_MARGIN, SHORT_MARGIN, APART_MARGIN = 4.0, 6.0, 1.5
#: Greatest log-odds of one feature, for and against residue: a passage has more ordinary words than telling ones.
FOR, AGAINST = 4.0, 2.3

# Wordings of error pages, script notices, expired sessions, removed posts and fillers.
TRUSTED = """
404 Not Found
404 - Page not found
404 - The page you requested could not be found.
Error 404: page not found
Page not found
The requested URL was not found on this server.
The requested URL was rejected.
Error 403: Forbidden
403 Forbidden
Access denied.
Access to this page has been denied.
You do not have permission to view this content.
You don't have permission to access this resource.
401 Unauthorized
400 Bad Request
500 Internal Server Error
500 Internal Server Error. Something went wrong on our end.
502 Bad Gateway
503 Service Unavailable
503 Service Temporarily Unavailable
504 Gateway Timeout
Gateway timeout: the upstream server did not respond in time.
HTTP 500 returned by upstream
The server is temporarily unable to service your request.
The server encountered an internal error and was unable to complete your request.
Something went wrong.
Something went wrong. Try reloading.
Oops! Something went wrong. Please try again later.
An error occurred.
An unexpected error occurred. Please try again later.
Sorry, we couldn't load this video.
Error code: 500
Request ID: 12345
Incident 1234-5678
Fatal error: maximum execution time of 30 seconds exceeded
Unable to connect to the database.
Error establishing a database connection
Unexpected token < in JSON at position 0
Unhandled exception
undefined
[object Object]
null
Too many requests.
You have been rate limited, wait a moment and retry.
This page isn't available.
Oops! This page isn't available.
The link may be broken, or the page may have been removed.
You have reached a page that is unavailable for viewing.
This content is no longer available.
This post has been deleted by its author.
This account is private or no longer exists.
This video is unavailable.
Video unavailable
Log in to see this post.
Your session has expired.
Your session has expired. Please log in again to continue.
Verify you are human to continue.
Please verify you are human before you continue.
Checking your browser before accessing this site.
Please enable JavaScript to continue.
Please enable JavaScript and cookies to continue.
You need to enable JavaScript to run this app.
JavaScript is required to view this page.
JavaScript is disabled in this browser.
JavaScript is not enabled in your browser.
We've detected that JavaScript is disabled in your browser.
We've detected that scripts are blocked in your browser.
Please enable scripts or switch to a supported browser.
This site works best with scripts turned on.
Turn off your script blocker and reload.
Switch it on or use a supported browser.
This page needs JavaScript to work.
Diese Seite existiert leider nicht mehr.
404 - Seite nicht gefunden
Die angeforderte Seite wurde nicht gefunden.
Zugriff verweigert.
Sie haben keine Berechtigung, diesen Inhalt zu sehen.
Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an.
Es ist ein Fehler aufgetreten.
Es ist ein Fehler aufgetreten. Bitte versuchen Sie es später erneut.
Der Server ist vorübergehend nicht erreichbar.
Bitte aktivieren Sie JavaScript, um fortzufahren.
Für diese Seite wird JavaScript benötigt.
In Ihrem Browser sind Skripte ausgeschaltet.
Erreur 404 : page introuvable
La page demandée n'existe plus.
Accès refusé.
Vous n'avez pas l'autorisation de voir ce contenu.
Votre session a expiré, veuillez vous reconnecter.
Une erreur est survenue.
Une erreur est survenue. Veuillez réessayer plus tard.
Service momentanément indisponible.
Veuillez activer JavaScript pour continuer.
Cette page nécessite JavaScript.
Les scripts sont bloqués dans votre navigateur.
Error 404: página no encontrada
La página solicitada ya no existe.
Acceso denegado. No tienes permiso para ver este contenido.
Tu sesión ha caducado. Vuelve a iniciar sesión.
Se ha producido un error. Inténtalo de nuevo más tarde.
El servidor no está disponible temporalmente.
Activa JavaScript para continuar.
Esta página necesita JavaScript para funcionar.
Los scripts están bloqueados en tu navegador.
Errore 404: pagina non trovata
Accesso negato.
La sessione è scaduta. Effettua di nuovo l'accesso.
Si è verificato un errore. Riprova più tardi.
Attiva JavaScript per continuare.
Erro 404: página não encontrada
Acesso negado.
A sua sessão expirou. Inicie sessão novamente.
Ocorreu um erro. Tente novamente mais tarde.
Ative o JavaScript para continuar.
Fout 404: pagina niet gevonden
Toegang geweigerd.
Uw sessie is verlopen. Meld u opnieuw aan.
Er is een fout opgetreden. Probeer het later opnieuw.
Schakel JavaScript in om door te gaan.
Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
Ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur
Excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum
Sample text. Replace me before publishing.
Your text here
Your text goes here
Text goes here
Description placeholder
Add a short description of this post.
Insert caption here
[Insert caption here]
Enter title
<enter title>
TODO: add description
Ihr Text hier
Hier steht Ihr Text
TODO: Beschreibung ergänzen
[Bildunterschrift hier einfügen]
[Insérer la légende ici]
[Insertar pie de foto aquí]
Votre texte ici
À FAIRE : ajouter une description
Escribe aquí tu texto
Tu texto aquí
PENDIENTE: añadir descripción
Il tuo testo qui
O seu texto aqui
Uw tekst hier
{{ name }}
Hi {{ first_name }},
Dear {{ first_name }}, your summary for {{ month }} is ready.
Dear {{ first_name }}, your order {{ order }} is ready.
Hello {{ name }}, thanks for following {{ company }} this month.
Hello {{ name }}, welcome to {{ company }}.
New post by {{ author }}: {{ title }}
{{ author }} shared a post with {{ name }}.
{{ user }} shared a memory with {{ name }}.
Read more about {{ company }} in our weekly letter.
{{ title }} - {{ excerpt }} - {{ date }}
{{ title }} | {{ date }}
{{ a }} {{ b }}
Hallo {{ name }}, danke für dein Interesse an {{ company }}.
Neuer Beitrag von {{ author }}: {{ title }}
Nouvelle publication de {{ author }} : {{ title }}
Nueva publicación de {{ author }}: {{ title }}
Nuovo post di {{ author }}: {{ title }}
Nova publicação de {{ author }}: {{ title }}
Nieuw bericht van {{ author }}: {{ title }}
Bonjour {{ name }}, merci de suivre {{ company }}.
Lieber {{ name }}, deine Übersicht für {{ month }} ist fertig.
{{ author }} hat eine Erinnerung mit {{ name }} geteilt.
{{ author }} a partagé un souvenir avec {{ name }}.
Hola {{ name }}, gracias por seguir {{ company }} este mes.
Bonjour {{ name }}, votre résumé de {{ company }} est prêt.
Estimado {{ name }}, tu resumen de {{ company }} está listo.
{{ author }} compartió un recuerdo con {{ name }}.
Ciao {{ name }}, grazie per seguire {{ company }}.
{{ author }} ha condiviso un ricordo con {{ name }}.
{{ author }} partilhou uma memória com {{ name }}.
{{ author }} heeft een herinnering gedeeld met {{ name }}.
Olá {{ name }}, obrigado por seguir {{ company }}.
Hallo {{ name }}, bedankt voor je interesse in {{ company }}.
"""

# What people write about errors, scripts and templates in ordinary posts.
ABOUT = """
I got an error message yesterday and just restarted the router. The server was down all morning, so we went for coffee. Does your browser still run scripts on every page? I switched them off and now half of the web is empty. My talk is about why pages should work without JavaScript. We replaced the placeholder text with a real one. She wrote a template for our letters and everyone likes it. They asked me to log in again, which took an hour. Why would a page refuse to open when I block scripts? He said the link was broken, so I sent it again.
Gestern kam wieder eine Fehlermeldung, aber ich habe nur neu gestartet. Warum brauchen so viele Seiten eigentlich JavaScript? Wir haben den Blindtext endlich ersetzt. Der Server war den ganzen Morgen weg.
J'ai encore vu un message d'erreur hier, mais tout marche maintenant. Pourquoi tant de sites ont besoin de JavaScript ? Nous avons remplacé le faux texte par le vrai.
Ayer vi otro mensaje de error, pero ya funciona todo. ¿Por qué tantos sitios necesitan JavaScript? Cambiamos el texto de relleno por el de verdad.
Ieri ho visto un altro messaggio di errore, ma adesso va tutto. Perché tanti siti hanno bisogno di JavaScript?
Ontem vi outra mensagem de erro, mas agora já funciona. Gisteren zag ik weer een foutmelding, maar nu werkt alles. Waarom hebben zoveel sites JavaScript nodig?
"""

_PLACEHOLDER = (
    r"\{\{\{?[^{}\n]{1,60}\}?\}\}|[$#]\{[^{}\n]{1,60}\}|\{%[^%\n]{1,60}%\}|<%=?[^%\n]{1,60}%>|\{[A-Za-z_][\w. ]{0,40}\}|\[\[[^\[\]\n]{1,60}\]\]"
    r"|<<[^<>\n]{1,60}>>|\*\|[\w.: ]{1,40}\|\*|%%[\w.]{1,40}%%|%[A-Za-z_][\w.]{1,40}%|\b__[A-Za-z][A-Za-z0-9_.]*?__|\[[A-Z][A-Z0-9]*(?:[_.][A-Z0-9]+)*\]"
)
_TOKEN = re.compile(rf"({_PLACEHOLDER})|(https?://\S+|www\.\S+|[#@](?=\w)[\w.-]+)|([^\W\d_]+(?:['’][^\W\d_]+)*)|(\d+)|([.!?…]+(?=\s|$)|\n)|([\[\]<>{{}}|/:])")
_KIND = {1: "‹field›", 4: "‹0›"}

_BARE = frozenset(["‹0›", *"[]<>{}|/:"])
_EDGE = _BARE | {"‹", "›"}


@dataclass
class Model:
    """Log-odds of each feature, of features never seen, and of the class."""

    weight: dict[str, float]
    prior: float
    short: frozenset[tuple[str, ...]] = frozenset()
    #: The trusted passages, and those of the sample that are residue by what is known apart from them.
    found: frozenset[tuple[str, ...]] = frozenset()

    def odds(self, tokens: list[str]) -> float:
        own = [t for t in tokens if t not in _BARE]
        if not own:
            return -np.inf  # bare numbers say nothing
        get = self.weight.get
        odds = self.prior + sum([get(f, 0.0) for f in features(tokens)])
        if tuple(tokens) in self.found:
            return max(odds, LEAST_ODDS + PART_MARGIN)
        return odds if len(own) > 2 or "‹field›" in own or tuple(own) in self.short else odds - SHORT_MARGIN


def features(tokens: list[str]) -> set[str]:
    """Words and pairs of a passage, with its ends. Numbers and signs tell something beside a word only."""
    found = set(tokens) - _BARE
    found.update(f"{a} {b}" for a, b in zip(["‹", *tokens], [*tokens, "›"]) if a not in _EDGE or b not in _EDGE)
    return found


def cut_passages(text: str) -> list[tuple[list[str], list[int]]]:
    """The tokens of each sentence or line that has any, and where in it a new sentence may begin
    without a stop before it: at a capital letter."""
    out: list[tuple[list[str], list[int]]] = []
    own: list[str] = []
    cuts: list[int] = []
    for m in _TOKEN.finditer(text):
        kind = m.lastindex
        if kind == 3:
            word = m[0]
            if own and word[0].isupper():
                cuts.append(len(own))
            own.append(word.lower())
        elif kind == 5:
            if own:
                out.append((own, cuts))
                own, cuts = [], []
        elif kind == 6:
            own.append(m[0])
        elif kind != 2:
            own.append(_KIND[kind])
    if own:
        out.append((own, cuts))
    return out


def passages(text: str) -> list[list[str]]:
    """The tokens of each sentence or line that has any."""
    return [p for p, _ in cut_passages(text)]


def _only_fields(tokens: list[str]) -> bool:
    return "‹field›" in tokens and all(t in "‹field›[]<>{}|/:" for t in tokens)


def trusted() -> list[list[str]]:
    return [p for line in TRUSTED.strip().splitlines() for p in passages(line)]


def _short() -> set[tuple[str, ...]]:
    """The trusted lines of one or two words, without bare tokens."""
    lines = [passages(line) for line in TRUSTED.strip().splitlines()]
    words = [tuple(t for t in p[0] if t not in _BARE) for p in lines if len(p) == 1]
    return {w for w in words if 0 < len(w) < 3}


def _sure_plain() -> tuple[set[tuple[str, ...]], set[tuple[str, ...]]]:
    """The passages that are residue, and those that are not."""
    sure = {tuple(p) for p in trusted()}
    return sure, {tuple(p) for t in [*SENTENCES.values(), ABOUT] for p in passages(t)} - sure


def _margin(tokens: list[str]) -> float:
    return APART_MARGIN + SHORT_MARGIN * (sum(t not in _BARE for t in tokens) < 3 and "‹field›" not in tokens)


def _weigh(n: np.ndarray, share: float) -> np.ndarray:
    # a wording that is stored often tells no more than a few of its kind
    x = n * share
    return np.where(x < 1, (1 + np.log(2)) * x, 1 + np.log1p(x))


def _log_odds(a: np.ndarray, b: np.ndarray, positive: float, total: float) -> np.ndarray:
    # both rates shrink to the feature's overall rate, so what was rarely seen tells little
    overall = (a + b + 0.1) / (total + 0.2)
    odds = np.log((a + overall) / (positive + 1)) - np.log((b + overall) / (total - positive + 1))
    return np.clip(odds * np.minimum(1.0, (a + b) / 2), -AGAINST, FOR)


def _prior(positive: float, total: float) -> float:
    rate = min(MOST_RESIDUE, (positive + 2) / (total + 4))
    return float(np.log(rate / (1 - rate)))


@dataclass
class _Rows:
    """Passages with their weights, whether they are residue or not for certain, and the features (of) of the rows (at)."""

    weight: np.ndarray
    fixed: np.ndarray
    ordinary: np.ndarray
    margin: np.ndarray
    at: np.ndarray
    of: np.ndarray

    def em(self, sums: np.ndarray, total: float, rounds: int) -> tuple[np.ndarray, float, float, np.ndarray]:
        """(a, positive, prior, score): the positive weight of each feature, that of all passages, and the scores of these ones.
        sums and total are the weights of the features and of all passages, also of those that aren't here."""
        p = self.fixed.astype(float)
        for _ in range(rounds):
            own = self.weight * p
            a, positive = np.bincount(self.of, own[self.at], len(sums)), float(own.sum())
            b, prior = np.maximum(0, sums - a), _prior(positive, total)
            rest = (self.weight - own)[self.at]
            apart = _log_odds(np.maximum(0, a[self.of] - own[self.at]), np.maximum(0, b[self.of] - rest), positive, total)
            score = prior + np.bincount(self.at, apart, len(p)) - self.margin
            p = np.where(self.fixed, 1.0, np.where(self.ordinary, 0.0, 1 / (1 + np.exp(-np.clip(score, -30, 30)))))
        return a, positive, prior, score


def _model(rows: list[tuple[str, ...]], made: _Rows, names: list[str], sums: np.ndarray, total: float, a: np.ndarray, positive: float, prior: float, score: np.ndarray) -> Model:
    odds = _log_odds(a, np.maximum(0, sums - a), positive, total)
    found = frozenset(rows[i] for i in np.flatnonzero(made.fixed | ~made.ordinary & (score >= LEAST_ODDS)))
    return Model({f: float(o) for f, o in zip(names, odds) if abs(o) > LEAST_WEIGHT}, prior, frozenset(_short()), found)


def fit(texts: list[str], rounds: int = ROUNDS) -> Model:
    """EM over the trusted passages (always positive) and those of the texts."""
    return _fit(Counter(tuple(p) for t in texts for p in passages(t)), len(texts), rounds)


def _fit(counts: Counter[tuple[str, ...]], size: int, rounds: int = ROUNDS) -> Model:
    share = min(1.0, SAMPLE_TEXTS / max(1, size))
    sure, plain = _sure_plain()
    rows = sorted(sure) + sorted({k for k in counts if k not in sure} | plain)
    index: dict[str, int] = {}
    at, of = [], []
    for i, r in enumerate(rows):
        for f in features(list(r)):
            at.append(i), of.append(index.setdefault(f, len(index)))
    known = np.array([r in sure or r in plain for r in rows])
    n = np.array([counts.get(r, 0) for r in rows], float)
    weight = np.where(known, 1 + np.log1p(n * share), _weigh(n, share))
    fixed = np.array([r in sure or _only_fields(list(r)) for r in rows])
    made = _Rows(weight, fixed, np.array([r in plain for r in rows]), np.array([_margin(list(r)) for r in rows]), np.array(at), np.array(of))
    sums, total = np.bincount(made.of, weight[made.at], len(index)), float(weight.sum())
    return _model(rows, made, list(index), sums, total, *made.em(sums, total, rounds))


def marked(text: str) -> str:
    """The passages of a text, one a line; a token where a new sentence may begin has the mark ^."""
    lines = []
    for tokens, cuts in cut_passages(text):
        for c in cuts:
            tokens[c] = "^" + tokens[c]
        lines.append(" ".join(tokens))
    return "\n".join(lines)


def _unmarked(line: str) -> tuple[list[str], list[int]]:
    tokens = line.split(" ")
    if "^" not in line:
        return tokens, []
    return [t.lstrip("^") for t in tokens], [i for i, t in enumerate(tokens) if t[0] == "^"]


def _fit_table(table: DataFrame, size: int, rounds: int = ROUNDS) -> Model:
    """fit() of a table (w, n) of different passages and their numbers in `size` texts, done by the executors."""
    spark = table.sparkSession
    sure, plain = _sure_plain()
    built_in = sorted(sure) + sorted(plain)
    names = {" ".join(r): i for i, r in enumerate(built_in)}
    counted = np.zeros(len(built_in))
    for r in table.filter(F.col("w").isin(*names)).collect():
        counted[names[r.w]] = r.n
    rest = table.filter(~F.col("w").isin(*names))
    share = min(1.0, SAMPLE_TEXTS / max(1, size))
    weight, x = 1 + np.log1p(counted * share), F.col("n") * share
    total = float(weight.sum()) + float(rest.agg(F.sum(F.when(x < 1, (1 + np.log(2)) * x).otherwise(1 + F.log1p(x)))).first()[0] or 0.0)

    def sum_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, float] = {}
            for w, x in zip(batch.column(0).to_pylist(), _weigh(batch.column(1).to_numpy(), share).tolist()):
                for f in features(w.split(" ")):
                    sums[f] = sums.get(f, 0.0) + x
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.float64())], ["f", "s"])

    # a feature of less weight can't have log-odds of LEAST_WEIGHT
    summed = rest.mapInArrow(sum_features, "f string, s double").groupBy("f").agg(F.sum("s").alias("s")).filter(F.col("s") * FOR / 2 > LEAST_WEIGHT)
    index: dict[str, int] = {}
    at, of = [], []
    for i, r in enumerate(built_in):
        for f in features(list(r)):
            at.append(i), of.append(index.setdefault(f, len(index)))
    sums = np.bincount(of, weight[at], len(index)).tolist()
    for r in sorted(summed.collect()):
        if (k := index.setdefault(r.f, len(index))) == len(sums):
            sums.append(r.s)
        else:
            sums[k] += r.s
    sums, known = np.array(sums), spark.sparkContext.broadcast(index)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [w.split(" ") for w in batch.column(0).to_pylist()]
            get = known.value.get
            ids = [[k for f in features(t) if (k := get(f)) is not None] for t in tokens]
            columns = [pa.array(_weigh(batch.column(1).to_numpy(), share)), pa.array([_margin(t) for t in tokens]), pa.array([_only_fields(t) for t in tokens]), pa.array(ids, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["w", "weight", "margin", "fixed", "ids"])

    schema = "w string, weight double, margin double, fixed boolean, ids array<int>"
    numbered = materialize(rest.mapInArrow(number, schema), "residue-features")
    ordinary = np.array([r in plain for r in built_in])
    chosen: dict[str, tuple] = {}
    made = _Rows(weight, np.array([r in sure or _only_fields(list(r)) for r in built_in]), ordinary, np.array([_margin(list(r)) for r in built_in]), np.array(at), np.array(of))
    while True:
        result = made.em(sums, total, rounds)
        fresh = [r for r in _needed(numbered, sums, total, *result[:3]) if r.w not in chosen]
        if not fresh:
            break
        chosen |= {r.w: r for r in fresh}
        more = [chosen[w] for w in sorted(chosen)]
        n = [len(r.ids) for r in more]
        made = _Rows(
            np.concatenate([weight, [r.weight for r in more]]), np.concatenate([made.fixed[: len(built_in)], [r.fixed for r in more]]), np.concatenate([ordinary, np.zeros(len(more), bool)]),
            np.concatenate([made.margin[: len(built_in)], [r.margin for r in more]]), np.concatenate([at, len(built_in) + np.repeat(np.arange(len(more)), n)]).astype(np.int64), np.concatenate([of, *[r.ids for r in more]]).astype(np.int64),
        )
    rows = built_in + [tuple(w.split(" ")) for w in sorted(chosen)]
    return _model(rows, made, list(index), sums, total, *result)


def _needed(numbered: DataFrame, sums: np.ndarray, total: float, a: np.ndarray, positive: float, prior: float) -> list:
    """The rows that are residue for certain or whose score, taken to be negative so far, is LEAST_SCORE or more."""
    shared = numbered.sparkSession.sparkContext.broadcast((a, sums - a))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = shared.value
        for batch in batches:
            ids, n = batch.column(4).flatten().to_numpy(), np.diff(batch.column(4).offsets.to_numpy())
            at, weight = np.repeat(np.arange(len(n)), n), batch.column(1).to_numpy()
            apart = _log_odds(a[ids], np.maximum(0, b[ids] - weight[at]), positive, total)
            score = prior + np.bincount(at, apart, len(n)) - batch.column(2).to_numpy()
            yield batch.filter(pa.array((score >= LEAST_SCORE) | batch.column(3).to_numpy(zero_copy_only=False)))

    return numbered.mapInArrow(run, numbered.schema).collect()


def sample_units(text: Column) -> Column:
    """The parts of SAMPLE_UNIT characters of a text, one row each; the text itself if it is no longer."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text)), F.lit(SAMPLE_UNIT))
    return F.explode(F.when(text.isNotNull(), F.transform(starts, lambda i: F.substring(text, i, SAMPLE_UNIT))))


def train(df: DataFrame, text: str) -> Model:
    """Fit on all texts; those longer than SAMPLE_UNIT characters are counted in units of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([marked(t) for t in fold(batch.column(0)).to_pylist()], pa.string())], ["m"])

    return train_marked(df.select(sample_units(F.col(text).cast("string")).alias("t")).mapInArrow(run, "m string"), "m")


def train_marked(table: DataFrame, column: str) -> Model:
    """Fit on all texts of a column of marked(), each different one once."""
    texts = table.select(F.translate(F.col(column), "^", "").alias("m")).distinct()
    lines = F.concat(F.split("m", "\n"), F.array(F.lit("^")))  # the sign counts the texts
    counts = texts.select(F.explode(lines).alias("w")).filter("w <> ''").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    every = materialize(counts, "residue-passages")
    size, kept = sum(r.n for r in every.filter("w = '^'").collect()), every.filter("w <> '^'")
    if kept.count() <= DRIVER_PASSAGES:
        return _fit(Counter({tuple(r.w.split(" ")): r.n for r in kept.collect()}), size)
    return _fit_table(kept, size)


def _passage_odds(tokens: list[str], cuts: list[int], model: Model) -> float:
    """Log-odds of a passage; of a part before or after a cut, if that alone is clearly residue."""
    odds = model.odds(tokens)
    if odds >= LEAST_ODDS or not cuts:
        return odds
    get = model.weight.get
    if sum(w for t in set(tokens) if (w := get(t, 0.0)) > 1.5) < -model.prior:
        return odds  # too little in it for any part to be residue
    parts = [q for c in cuts for q in (tokens[:c], tokens[c:]) if len(q) > 2]
    best = max(map(model.odds, parts), default=-np.inf)
    return best if best >= LEAST_ODDS + PART_MARGIN else odds


def residue_odds(texts: list[str | None], model: Model) -> list[float]:
    """The greatest log-odds of a passage of each text; -inf without passages."""
    return [max([_passage_odds(p, c, model) for p, c in cut_passages(t)], default=-np.inf) if t else -np.inf for t in texts]


def marked_odds(texts: list[str], model: Model) -> list[float]:
    """residue_odds() of texts that marked() has cut."""
    return [max([_passage_odds(*_unmarked(line), model) for line in m.split("\n")], default=-np.inf) if m else -np.inf for m in texts]


def flags(column: pa.Array, model: Model, least: float = LEAST_ODDS) -> np.ndarray:
    """Which texts hold residue."""
    return np.array(residue_odds(fold(column).to_pylist(), model)) >= least


def scored(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """(key, odds, residue) of every row; odds is null where there is nothing to score."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = np.array(residue_odds(fold(batch.column(1)).to_pylist(), shared.value), float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(odds, mask=np.isneginf(odds)), pa.array(odds >= LEAST_ODDS)], [key, "odds", "residue"])

    kind = dict(df.dtypes)[key]
    return df.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(run, f"{key} {kind}, odds double, residue boolean")


def residue(df: DataFrame, key: str, text: str, model: Model | None = None) -> DataFrame:
    """The distinct keys of rows that hold residue."""
    return scored(df, key, text, model or train(df, text)).filter("residue").select(key).distinct()
