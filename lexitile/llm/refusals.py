"""Telling replies that decline a task from content, by a classifier over sentences.

A logistic regression on words, word pairs and word stems, fitted with follow-the-regularised-leader under elastic-net penalties. Its
positive samples are put together from the parts of a refusal (an apology, the inability, what is declined, a reason, an offer), its
negative ones are ordinary first-person sentences put together alike and a bounded sample of source sentences, which are content.
A text declines if one sentence clearly does and such sentences hold most of its words.

Defined cases: a text without words declines nothing; a reply whose prompt reads as a refusal itself is content.
"""

from __future__ import annotations

import math
import random

from lexitile.llm.texts import prose_sentences

#: Parts of refusals by language: openings, how one declines, what is declined, endings. '|' parts alternatives.
REFUSING = {
    "English": (
        "I am sorry, but|I'm sorry, but|I apologize, but|Sorry,|Unfortunately,|As an AI language model,|I regret that|Thank you for your request, but|",
        "I cannot translate {}|I can't translate {}|I am unable to help with {}|I am not able to process {}|I won't translate {}|I must decline to translate {}|I have to refuse {}|I do not have permission to process {}|my guidelines do not allow me to translate {}"
        "|my rules forbid me to put {} into another language|I am not allowed to rewrite {}|{} goes beyond what I can do|{} is not something I can translate|{} is not something I may put into other words|translating {} is beyond what I am allowed to do|a human translator should handle {}|it would be better to leave {} to a professional translator|nothing will be translated here|I cannot assist with {}|I cannot provide a translation of {}|I cannot fulfil {}",
        "this text|this passage|this request|this content|this part|the translation|that|the section you sent|this question|the passage about §|the part on §|the text on §|translating §|a translation of §",
        "because it may be protected.|without more context.|. Please send a different text.|as it violates my policy.|. Please provide more context.|.|. Is there anything else I can help you with?|. The context is missing.",
    ),
    "French": (
        "Je suis désolé, mais|Désolé,|Malheureusement,|Je m’excuse, mais|Je regrette, mais|En tant que modèle de langue,|Toutes mes excuses, mais|",
        "je ne peux pas traduire {}|je ne suis pas en mesure d’aider avec {}|je dois refuser de traduire {}|il m’est impossible de fournir {}|mes consignes ne me permettent pas de traiter {}|mes règles m’interdisent de rendre {} dans une autre langue|je ne suis pas autorisé à traiter {}"
        "|un traducteur humain devrait s’occuper de {}|{} dépasse ce que je peux faire|mieux vaut confier {} à un traducteur|je refuse de traduire {}|je ne peux pas répondre à {}|je décline {}|rien ne sera traduit ici",
        "ce texte|ce passage|cette demande|ce contenu|cette traduction|cette partie|cela|cette question|le passage sur §|la partie sur §|le texte sur §|la traduction de §",
        "car le contenu est peut-être protégé.|sans plus de contexte.|. Merci d’envoyer un autre texte.|. Veuillez fournir plus de contexte.|.|. Il me manque le contexte.|. Puis-je vous aider autrement ?",
    ),
    "German": (
        "Es tut mir leid, aber|Tut mir leid,|Leider|Ich bitte um Entschuldigung, aber|Entschuldigung,|Ich bedaure, aber|Als Sprachmodell|",
        "ich kann {} nicht übersetzen|kann ich {} nicht übersetzen|ich kann bei {} nicht helfen|ich darf {} nicht bearbeiten|darf ich {} nicht übertragen|ich muss {} ablehnen|muss ich {} ablehnen|ich bin nicht in der Lage, {} zu übersetzen|meine Richtlinien erlauben {} nicht|meine Vorgaben verbieten mir, {} zu übertragen"
        "|{} sollte ein menschlicher Übersetzer bearbeiten|{} geht über das hinaus, was ich leisten kann|ich werde {} nicht übersetzen|ich kann diese Anfrage nicht bearbeiten|hier wird nichts übersetzt|{} überlässt man besser einem Menschen",
        "diesen Text|diesen Abschnitt|diese Anfrage|diesen Inhalt|diese Übersetzung|diesen Teil|das|diese Frage|den Abschnitt über §|den Teil zu §|den Text über §|die Übersetzung von §",
        ", weil er geschützt sein könnte.|ohne weiteren Zusammenhang.|. Bitte senden Sie einen anderen Text.|. Mir fehlt der Zusammenhang.|.|. Bitte geben Sie mehr Kontext.|. Kann ich sonst helfen?",
    ),
    "Spanish": (
        "Lo siento, pero|Lo siento,|Disculpe, pero|Lamentablemente,|Por desgracia,|Perdón, pero|Como modelo de lenguaje,|Le pido disculpas, pero|",
        "no puedo traducir {}|no puedo ayudar con {}|no me es posible ofrecer {}|no estoy autorizado a procesar {}|no soy capaz de traducir {}|debo rechazar {}|me veo obligado a rechazar {}|mis normas no me permiten traducir {}|mis directrices impiden pasar {} a otro idioma"
        "|conviene que una persona traduzca {}|un traductor humano debería encargarse de {}|{} va más allá de lo que puedo hacer|no voy a traducir {}|no puedo atender {}|aquí no se traducirá nada",
        "este texto|este pasaje|esta petición|este contenido|esta traducción|esta parte|eso|esta solicitud|esta pregunta|el pasaje sobre §|la parte sobre §|el texto sobre §|la traducción de §",
        ", porque el contenido podría estar protegido.|sin más contexto.|. Por favor, envíe otro texto.|. Me falta el contexto.|.|. ¿Puedo ayudar en algo más?",
    ),
    "Ukrainian": (
        "Вибачте, але|На жаль,|Перепрошую, але|Мені шкода, але|Прошу вибачення, але|Як мовна модель,|Даруйте, але|",
        "я не можу перекласти {}|я не можу допомогти з {}|я не маю дозволу на обробку {}|я мушу відмовитися від {}|я змушений відхилити {}|я не в змозі надати {}|мої правила забороняють перекладати {}|мої інструкції не дозволяють мені обробляти {}"
        "|{} краще довірити людині|цим має займатися перекладач-людина|{} виходить за межі того, що я можу|я не перекладатиму {}|я не можу виконати {}|я не вмію перекладати {}|тут нічого не буде перекладено",
        "цей текст|цей уривок|цей запит|цей вміст|цей переклад|цю частину|це|це прохання|це питання|уривок про §|частину про §|текст про §|переклад §",
        ", бо вміст може бути захищений.|без додаткового контексту.|. Будь ласка, надішліть інший текст.|. Мені бракує контексту.|.|. Чи можу я ще чимось допомогти?",
    ),
    "Armenian": (
        "Ներողություն, բայց|Ցավոք,|Կներեք, բայց|Ցավում եմ, բայց|Որպես լեզվական մոդել՝|Կներեք,|Ներեցեք, բայց|",
        "ես չեմ կարող թարգմանել {}|չեմ կարող օգնել {}|ես ի վիճակի չեմ տրամադրել {}|իմ կանոնները թույլ չեն տալիս թարգմանել {}|իմ ուղեցույցները արգելում են {} այլ լեզվով ներկայացնել|ստիպված եմ հրաժարվել {}|ես թույլտվություն չունեմ մշակել {}|{} թող թարգմանի մարդը"
        "|{} ավելի լավ է վստահել մարդուն|պետք է հրաժարվեմ {}|ես չեմ թարգմանի {}|չեմ կարող կատարել {}|այստեղ ոչինչ չի թարգմանվի",
        "այս տեքստը|այս հատվածը|այս հարցումը|այս բովանդակությունը|այս թարգմանությունը|այս մասը|դա|այս հարցում|այս տեքստից|այս հարցը|§ մասին հատվածը|§ մասին տեքստը|§ թարգմանությունը",
        ", քանի որ բովանդակությունը կարող է պաշտպանված լինել։|առանց հավելյալ համատեքստի։|։ Խնդրում եմ ուղարկել այլ տեքստ։|։ Ինձ համատեքստ է պակասում։|։|։ Ուրիշ ինչո՞վ կարող եմ օգնել։",
    ),
}
#: Parts of ordinary sentences in the first person and of sentences about what can't be done.
ORDINARY = {
    "English": ("First|Here|Now|In this chapter|Then|Please note that|Unfortunately,|I am sorry, but|Sorry,|I apologize, but|", "I must {}|I can {}|I cannot {}|I do not {}|I have to {}|we can {}|we cannot {}|my task is to {}|the server cannot {}|the reader must {}|a program may {}|nobody can {}|the rules do not allow us to {}|it is not possible to {}|this task is unsolvable: nobody can {}", "normalise the vector|load the data|show that the theorem holds|reject the null hypothesis|find the file|solve the equation|repeat the measurement|open the window|read the page again|choose a smaller step|send a request|explain the context|check the content"),
    "French": ("D’abord|Ici|Maintenant|Dans ce chapitre|Ensuite|Notez que|Malheureusement,|Je suis désolé, mais|Désolé,|Je regrette, mais|", "je dois {}|je peux {}|je ne peux pas {}|il me faut {}|nous pouvons {}|nous ne pouvons pas {}|mon but est de {}|le serveur ne peut pas {}|on doit {}|mes calculs permettent de {}|il n’est pas possible de {}|cette tâche est impossible : personne ne peut {}", "charger les données|normaliser le vecteur|montrer que le théorème est vrai|rejeter l’hypothèse nulle|trouver le fichier|résoudre l’équation|répéter la mesure|relire la page|envoyer une requête|vérifier le contenu|expliquer le contexte"),
    "German": ("Zuerst|Hier|Nun|In diesem Kapitel|Dann|Man beachte:|Leider|Es tut mir leid, aber|Entschuldigung,|Ich bedaure, aber|", "muss ich {}|kann ich {}|ich muss {}|ich kann {}|ich kann nicht {}|wir können {}|wir können nicht {}|meine Aufgabe ist, {}|der Server kann nicht {}|man darf {}|meine Messung soll {}|es ist nicht möglich, {}|diese Aufgabe ist unlösbar: niemand kann {}", "die Daten laden|den Vektor normieren|zeigen, dass der Satz gilt|die Nullhypothese ablehnen|die Datei finden|die Gleichung lösen|die Messung wiederholen|die Seite noch einmal lesen|eine Anfrage senden|den Inhalt prüfen|den Zusammenhang erklären"),
    "Spanish": ("Primero|Aquí|Ahora|En este capítulo|Después|Nótese que|Por desgracia,|Lamentablemente,|Lo siento, pero|Disculpe, pero|Perdón,|", "debo {}|puedo {}|no puedo {}|tengo que {}|podemos {}|no podemos {}|mi tarea es {}|el servidor no puede {}|hay que {}|mis datos permiten {}|no es posible {}|esta tarea es imposible: nadie puede {}", "cargar los datos|normalizar el vector|mostrar que el teorema es válido|rechazar la hipótesis nula|encontrar el fichero|resolver la ecuación|repetir la medición|leer otra vez la página|enviar una petición|comprobar el contenido|explicar el contexto"),
    "Ukrainian": ("Спочатку|Тут|Тепер|У цьому розділі|Потім|Зауважте, що|На жаль,|Вибачте, але|Перепрошую, але|Мені шкода, але|", "я мушу {}|я можу {}|я не можу {}|не можу {}|ми можемо {}|ми не можемо {}|моє завдання — {}|сервер не може {}|треба {}|мої дані дозволяють {}|неможливо {}|це завдання неможливе: ніхто не може {}", "завантажити дані|нормувати вектор|показати, що теорема правильна|відхилити нульову гіпотезу|знайти файл|розв’язати рівняння|повторити вимірювання|прочитати сторінку ще раз|надіслати запит|перевірити вміст|пояснити контекст"),
    "Armenian": ("Նախ|Այստեղ|Հիմա|Այս գլխում|Հետո|Նկատենք, որ|Ցավոք,|Կներեք, բայց|Ներողություն, բայց|Ցավում եմ, բայց|", "ես պետք է {}|ես կարող եմ {}|ես չեմ կարող {}|չեմ կարող {}|մենք կարող ենք {}|մենք չենք կարող {}|իմ խնդիրն է {}|սերվերը չի կարող {}|պետք է {}|իմ տվյալները թույլ են տալիս {}|հնարավոր չէ {}|այս խնդիրն անհնար է. ոչ ոք չի կարող {}", "բեռնել տվյալները|նորմավորել վեկտորը|ցույց տալ, որ թեորեմը ճիշտ է|մերժել զրոյական վարկածը|գտնել նիշքը|լուծել հավասարումը|կրկնել չափումը|նորից կարդալ էջը|ուղարկել հարցում|ստուգել բովանդակությունը|բացատրել համատեքստը"),
}
#: Others than the speaker who can't do what refusals decline.
OTHERS = {
    "English": ("the server cannot {}|this program cannot {}|a parser is unable to {}|the students do not {}|the old tool must not {}|no machine will {}", "translate this file and prints an error|translate the text|process this request|handle this content|help the reader|translate the passage without a dictionary"),
    "French": ("le serveur ne peut pas {}|ce programme ne peut pas {}|l’outil n’est pas en mesure de {}|les étudiants ne doivent pas {}|aucune machine ne va {}", "traduire ce fichier et affiche une erreur|traduire le texte|traiter cette demande|fournir ce contenu|aider le lecteur|traduire le passage sans dictionnaire"),
    "German": ("der Server kann {}|das Programm kann {}|das Werkzeug darf {}|die Studierenden müssen {}|keine Maschine wird {}", "diese Datei nicht übersetzen und meldet einen Fehler|den Text nicht übersetzen|diese Anfrage nicht bearbeiten|diesen Inhalt nicht prüfen|den Abschnitt ohne Wörterbuch übersetzen|dem Leser nicht helfen"),
    "Spanish": ("el servidor no puede {}|este programa no puede {}|la herramienta no es capaz de {}|los estudiantes no deben {}|ninguna máquina va a {}", "traducir este fichero y muestra un error|traducir el texto|procesar esta petición|ofrecer este contenido|ayudar al lector|traducir el pasaje sin diccionario"),
    "Ukrainian": ("сервер не може {}|ця програма не може {}|інструмент не в змозі {}|студенти не мають {}|жодна машина не буде {}", "перекласти цей файл і повідомляє про помилку|перекласти текст|обробити цей запит|надати цей вміст|допомогти читачеві|перекласти уривок без словника"),
    "Armenian": ("սերվերը չի կարող {}|այս ծրագիրը չի կարող {}|գործիքն ի վիճակի չէ {}|ուսանողները չպետք է {}|ոչ մի մեքենա չի {}", "թարգմանել այս նիշքը և սխալ է հաղորդում|թարգմանել տեքստը|մշակել այս հարցումը|տրամադրել այս բովանդակությունը|օգնել ընթերցողին|թարգմանել հատվածն առանց բառարանի"),
}
#: Sentences put together for each language and class, and the bound of source sentences taken.
SAMPLES, MAX_SOURCES = 600, 2_000
CLEAR = 0.25
STEM = 4


def labelled_sentences() -> list[tuple[str, str]]:
    """``(language, text)`` of all the parts, each in a sentence of its own: every way of speaking with a start, an object and an end in turn."""
    out = []
    for source in (REFUSING, ORDINARY, OTHERS):
        for lang, parts in source.items():
            start, way, what, end = ["", *parts, ""] if source is OTHERS else [*parts, *[""] * (4 - len(parts))]
            start, way, what, end = (x.split("|") for x in (start, way, what.replace("§", ""), end))
            n = max(map(len, (start, way, what, end)))
            out += [(lang, f"{start[k % len(start)]} {way[k % len(way)].replace('{}', what[k % len(what)])} {end[k % len(end)]}".strip()) for k in range(n)]
    return out


def features(words: list[str]) -> list[str]:
    low = [w.lower() for w in words]
    return [*low, *(f"{a} {b}" for a, b in zip(["", *low], [*low, ""])), *(f"{w[:STEM]}*" for w in low if len(w) > STEM)]


class RefusalModel:
    """Weights of features; words seen nowhere in the samples speak for content."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def logit(self, words: list[str]) -> float:
        get, f = self.weights.get, features(words)
        return self.bias + sum(get(x, 0.0) for x in f) / math.sqrt(len(f) or 1)

    def declines(self, sentences: list[list[str]]) -> bool:
        n, refusing, clear = 0, 0, False
        for s in sentences:
            z = self.logit(s)
            n += len(s)
            refusing += len(s) if z > 0 else 0
            clear = clear or z > CLEAR
        return clear and 2 * refusing > n


def composed(rng: random.Random, content: list[tuple[str, list[str]]]) -> list[tuple[int, str]]:
    """``(class, text)`` samples put together from the parts; '§' stands for words of the content, so that they speak for neither class."""
    out = []
    pick = lambda parts: rng.choice(parts.split("|"))
    by_lang = {lang: [s for x, s in content if x == lang] or [["x"]] for lang in REFUSING}

    def about(lang: str) -> str:
        s = rng.choice(by_lang[lang])
        k = rng.randrange(len(s))
        return " ".join(s[k : k + rng.randint(1, 3)])

    for lang, (start, way, what, end) in REFUSING.items():
        for e in (pick(end) for _ in range(SAMPLES)):
            out.append((1, f"{pick(start)} {pick(way).replace('{}', pick(what).replace('§', about(lang)))}{' ' * (e[0] not in '.,։')}{e}"))
    for start, way, what in ORDINARY.values():
        out += [(0, f"{pick(start)} {pick(way).replace('{}', pick(what))}.") for _ in range(SAMPLES)]
    for way, what in OTHERS.values():
        out += [(0, f"{pick(way).replace('{}', pick(what))}.") for _ in range(SAMPLES // 2)]
    return out


def fit_refusals(content: list[tuple[str, list[str]]], epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> RefusalModel:
    """Fit on composed samples and at most ``MAX_SOURCES`` content sentences ``(language, words)``."""
    rng, content = random.Random(11), content[:MAX_SOURCES]
    data = [(y, s) for y, text in composed(rng, content) for s in prose_sentences(text)] + [(0, s) for _, s in content]
    z: dict[str, float] = {}
    n: dict[str, float] = {}
    zb = nb = 0.0

    def weight(z: float, n: float, l1: float) -> float:
        return 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / ((beta + math.sqrt(n)) / alpha + l2)

    rows = [(y, features(s)) for y, s in data]
    for _ in range(epochs):
        rng.shuffle(rows)
        for y, f in rows:
            x = 1 / math.sqrt(len(f))
            w = {k: weight(z.get(k, 0.0), n.get(k, 0.0), l1) for k in set(f)}
            b = weight(zb, nb, 0.0)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, b + x * sum(w[k] for k in f)))))
            for k, v in w.items():
                g = (p - y) * x
                old = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * v
                n[k] = old + g * g
            g = p - y
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha * b
            nb += g * g
    kept = {k: v for k in z if (v := weight(z[k], n[k], l1))}
    return RefusalModel(kept, weight(zb, nb, 0.0))
