"""Problem 10 on messages and notices that were written after the stems, and were not used to choose them.

At first writing 34 of the 40 messages were found; function words were completed after that, no stem was added.
"""

import pytest

from foliospark.llm import residue

MESSAGES = """
404: File not found.
The website is temporarily unreachable.
Your request could not be completed. Please retry in a few minutes.
This link has expired.
You do not have access to this document.
The host refused the connection.
An unexpected exception was thrown while loading the page.
Our servers are down for maintenance. Please check back shortly.
Sorry, this article is no longer available.
We're sorry, but the page failed to load.
To continue, enable cookies and reload the page.
This application needs JavaScript to run.
Scripts are blocked by your browser. Please allow them.
Confirm that you are not a robot.
Your text here.
Placeholder for the summary.
Abstract to be written.
This section will be completed later.
Insert the abstract of your paper here.
Hello {{ user.name }}, your invoice {{ invoice.id }} is ready.
Sehr geehrte Frau ${nachname}, Ihr Termin ist am ${datum}.
Die Seite ist derzeit nicht erreichbar.
Zugriff auf dieses Dokument verweigert.
JavaScript muss aktiviert sein, um diese Seite anzuzeigen.
La page demandée est introuvable.
Une erreur interne est survenue.
JavaScript est désactivé dans votre navigateur.
No se pudo cargar el contenido.
Error 500 del servidor.
Il server non risponde. Riprova più tardi.
Não foi possível abrir o arquivo.
Toegang tot deze pagina geweigerd.
Ett fel inträffade. Försök igen senare.
Der opstod en fejl på serveren.
Pääsy estetty.
Nie można załadować strony.
Сервер недоступен. Попробуйте позже.
网页无法显示，请稍后重试。
サーバーエラーが発生しました。
JavaScript를 활성화 해 주세요.
""".strip().split("\n")

CONTENT = """
The reader of the page saw no error in 12.4% of the cases.
We report the error of the model on each page of the document.
JavaScript and Python files were parsed with the same grammar.
Each text was replaced by its summary before the second round.
Cookies were used as an example of a narrow topic in three prompts.
Access to the corpus is granted on request by the authors of the card.
The browser of the annotators logged 19 clicks for each item.
A gateway node forwards the tokens to four workers.
Answers that say "page not found" were counted as refusals.
The template {title} ({year}) was filled from the catalogue for all of the 2,400 records.
Later versions of the server cut the cost by 12 milliseconds.
Two pages of the appendix list the failures of the parser.
The abstract and the summary of a paper share most of their words.
In the sample, 40 placeholder tokens stand for names of people.
The request was sent three times and the median is reported.
We thank the administrators of the cluster for their support.
""".strip().split("\n")


def test_messages_that_were_never_listed():
    hits = [residue.judge(m)[0] is not None for m in MESSAGES]
    assert sum(hits) >= 0.9 * len(MESSAGES)


@pytest.mark.parametrize("text", CONTENT)
def test_content_that_speaks_of_errors(text):
    assert residue.judge(text)[0] is None


def test_long_field_names_and_quotations():
    assert residue.judge("Dear {{" + "x" * 300 + "}}, welcome.")[0] == "template"
    assert residue.judge('The form asks for "' + "a name, " * 60 + '{{name}}" and for a date.')[0] is None
