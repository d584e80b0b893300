"""Refusals: replies that decline and give no answer.

A clause becomes a sequence of classes (who cannot or will not, what they don't
do, where the limits are ...), found by a multi-pattern automaton over a lexicon
of seven languages; it is aligned with templates, which are sequences of classes
too, by longest common subsequence.  A clause refuses if a template lies in it
whole.  A reply is a refusal if one of its clauses refuses and all others are
politeness, a hint at somebody or something else, or a few words on the topic.
The lexicon has words and short phrases, no whole refusals, and there is no
limit on the length of a reply.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

# The lexicon, by class.  Words with a capital at the end of the class name are phrases of that class.
LEXICON = {
    # cannot, will not, may not
    "not": (
        "can't|cannot|can not|couldn't|won't|will not|wouldn't|unable|not able|not allowed|not permitted|not authorised|not authorized|not in a position|not qualified|not equipped|not capable|incapable|"
        "don't have the ability|do not have the ability|lack the ability|not going to|does not allow|doesn't allow|do not allow|don't allow|do not permit|does not permit|don't permit|prevents me|prevent me|rather not|"
        "prefer not|mustn't|must not|may not|not comfortable|not something|nothing i can|no way for me|not possible|impossible|not willing|unwilling|not free|not designed|not meant|isn't able|aren't able|shouldn't|"
        "nobody can|never|"
        "无法|不能|不可以|不会|不便|不方便|不予|没法|没有办法|没办法|没有资格|无权|没有权限|不具备|没有能力|无力|不允许|不被允许|不宜|暂不|不再|不得|不愿|不想|不打算|难以|不适合|不好|不敢|没有义务|拒不|未能|不作|不做|没有条件|没有|不|"
        "ne peux pas|ne peut pas|ne pouvons pas|ne peux malheureusement pas|ne suis pas en mesure|ne suis pas autorisé|ne suis pas habilité|ne souhaite pas|ne veux pas|ne vais pas|ne saurais|ne pourrai pas|n'ai pas le droit|n'est pas possible|impossible|"
        "kann nicht|kann ich nicht|kann ich leider nicht|kann ich dir nicht|kann ich ihnen nicht|kann leider nicht|können wir nicht|können wir leider nicht|darf nicht|darf ich nicht|darf ich leider nicht|möchte ich nicht|möchte nicht|werde nicht|werde ich nicht|"
        "nicht in der lage|nicht möglich|nicht befugt|nicht berechtigt|außerstande|nicht|keine|keinen|"
        "no puedo|no podemos|no me es posible|no estoy autorizado|no estoy autorizada|no tengo permitido|no soy capaz|no debo|no quiero|no voy a|no es posible|no me está permitido|no podré|imposible|"
        "не могу|не можем|не смогу|не сможем|не вправе|не имею права|невозможно|не в состоянии|не буду|не уполномочен|не стану|не готов|не хочу|нельзя|"
        "できません|できない|できかね|いたしかね|かねます|致しかね|ません|られません|できかねます"
    ),
    # what is not done
    "act": (
        "answer|answering|answers|help|helping|assist|assisting|assistance|respond|responding|response|reply|replying|provide|providing|give|giving|offer|offering|advise|advising|advice|comment|commenting|discuss|discussing|talk|talking|"
        "fulfil|fulfill|fulfilling|comply|complying|handle|handling|process|complete|share|sharing|tell|say|address|addressing|support|do that|do this|do so|engage|generate|write|produce|speak|weigh in|opinion|opinions|judge|judgement|"
        "guidance|recommendation|recommendations|information on|accommodate|entertain|satisfy|get into|go into|cover|proceed|continue with|carry out|"
        "回答|答复|回复|回应|解答|作答|帮|帮助|帮忙|协助|提供|给出|给您|给你|给予|讨论|谈论|谈|交流|处理|评论|评价|置评|判断|发表|满足|执行|完成|告诉|告知|透露|支持|受理|参与|探讨|展开|作出|做出|办理|答|说|聊|继续|奉告|从命|效劳|分析|解决|诊断|意见|服务|"
        "répondre|réponse|aider|assister|fournir|donner|discuter|commenter|traiter|parler|conseiller|satisfaire|accéder|aborder|renseigner|dire|avis|"
        "beantworten|antworten|antwort|helfen|weiterhelfen|unterstützen|geben|bereitstellen|diskutieren|kommentieren|sagen|bearbeiten|auskunft|äußern|erfüllen|besprechen|beraten|eingehen|stellung|"
        "responder|contestar|ayudar|ayudarle|ayudarte|asistir|proporcionar|dar|darle|ofrecer|discutir|comentar|hablar|atender|cumplir|opinar|aconsejar|tratar|responderle|"
        "ответить|отвечать|ответ|помочь|помогать|предоставить|дать|обсуждать|комментировать|сказать|выполнить|консультировать|говорить|советовать|обсудить|"
        "お答え|回答|返答|お手伝い|手伝|提供|対応|応じ|コメント|助言|アドバイス|案内|お話し|説明|サポート|答え|お応え|ご案内|お受け"
    ),
    # declining by itself
    "decline": (
        "decline to|must decline|i decline|have to decline|respectfully decline|politely decline|declining|refuse to|i refuse|refusing|no comment|unanswered|leave it there|leave it at that|remain silent|stay silent|keep silent|i pass|i'll pass|off limits|off-limits|"
        "have to pass|not take part|turn this down|turn that down|say nothing|can't comment|cannot comment|stay out of|"
        "拒绝|恕难|恕不|恕我|无可奉告|沉默|爱莫能助|帮不上|帮不了|不帮|答不了|答不上来|办不到|做不到|无能为力|谢绝|婉拒|另请高明|力不能及|力不从心|力所不及|难以从命|不作答|不回答|不答复|免谈|处理不了|解决不了|回答不了|回答不出|不予置评|不予回应|说不了|给不了|不奉陪|"
        "je refuse|je décline|dois refuser|dois décliner|pas de commentaire|"
        "lehne ich ab|lehne das ab|lehne ab|muss ich ablehnen|ich verweigere|kein kommentar|muss ablehnen|ablehnen|"
        "me niego|declino|debo rechazar|tengo que rechazar|sin comentarios|"
        "отказываюсь|вынужден отказать|вынуждена отказать|воздержусь|без комментариев|откажусь|"
        "お断り|控えさせて|差し控え|遠慮させて|ご遠慮|ノーコメント|回答を控え"
    ),
    # beyond
    "out": (
        "outside|beyond|out of|exceeds|exceed|not within|not in|falls outside|not part of|isn't within|isn't part of|not covered|above|"
        "超出|超过|超越|不在|不属于|不是我|并非|超纲|"
        "außerhalb|übersteigt|überschreitet|gehört nicht|en dehors|dépasse|hors de|sort du|fuera de|más allá|excede|supera|sobrepasa|вне|за рамками|выходит за|за пределами|範囲外|対象外|超えて"
    ),
    # of what can be done
    "range": (
        "scope|what i can|what i'm able|what i am able|what i'm allowed|what we can|my abilities|abilities|capabilities|remit|competence|my range|expertise|knowledge|my role|my area|limits|purview|pay grade|my field|"
        "范围|能力|职责|权限|业务|职能|领域|专长|"
        "champ|compétences|capacités|domaine|mes attributions|möglichkeiten|zuständigkeit|kompetenz|kompetenzen|fähigkeiten|bereich|rahmen|aufgaben|alcance|capacidades|competencia|competencias|ámbito|функций|компетенции|возможностей|полномочий|рамки|範囲|範囲外|対象外|能力|専門外"
    ),
    # another topic
    "else": (
        "something else|another topic|a different topic|another subject|different subject|other topics|other things|another question|a different question|anything but|something different|change the subject|switch topics|"
        "别的|其他话题|其它话题|换个话题|别的话题|换个问题|其他事|其它事|换一个话题|换一个问题|另外的话题|其他问题|"
        "autre chose|un autre sujet|d'autre|etwas anderes|anderes thema|anderen thema|otra cosa|otro tema|другом|другую тему|что-нибудь другое|別の話|別の話題|ほかの話|他の話"
    ),
    "let": "let's|let us|shall we|why don't we|could we|we could|how about|may i suggest|不如|我们|咱们|要不|聊|谈谈|换|parlons|lassen sie uns|lass uns|hablemos|давайте|ましょう",
    # rules
    "rule": (
        "guidelines|guideline|policy|policies|rules|terms of use|regulations|my programming|my instructions|safety reasons|legal reasons|privacy reasons|"
        "规范|规定|政策|条款|准则|规则|法规|要求|règles|directives|politique|richtlinien|regeln|vorgaben|normas|políticas|reglas|directrices|правила|правилам|規約|ポリシー|規定|ガイドライン"
    ),
    "against": "against|violates|violate|forbid|forbids|prohibit|prohibits|breach|breaches|违反|违背|不符合|不符|违规|不合|禁止|interdisent|contraire|verstößt|verbieten|untersagen|contra|prohíben|prohíbe|нарушает|запрещают|противоречит|違反|反する|禁じ",
    # a machine
    "ai": "ai|as an ai|an ai|language model|ai model|ai assistant|virtual assistant|chatbot|machine|人工智能|语言模型|ai助手|ai模型|智能助手|机器人|程序|intelligence artificielle|modèle de langage|ki|sprachmodell|inteligencia artificial|modelo de lenguaje|искусственный интеллект|языковая модель|人工知能|言語モデル",
    # doesn't know
    "unknown": (
        "don't know|do not know|no idea|no information|not familiar|no knowledge|not aware|don't have information|do not have information|not sure how|not informed|know nothing|have no clue|"
        "不了解|不知道|不清楚|不懂|不熟悉|一无所知|没有了解|je ne sais pas|aucune idée|weiß ich nicht|weiß nicht|keine ahnung|no sé|lo desconozco|ni idea|не знаю|понятия не имею|わかりません|分かりません|存じません|存じ上げ"
    ),
    # somebody else
    "who": (
        "professional|professionals|doctor|doctors|physician|specialist|specialists|expert|experts|qualified|lawyer|pharmacist|clinician|somebody else|someone else|your gp|healthcare provider|"
        "专业|医生|大夫|医师|专家|律师|药师|医院|别人|他人|懂行|高明|médecin|professionnel|spécialiste|expert|pharmacien|arzt|ärztin|fachmann|fachperson|fachleute|experten|profesional|médico|especialista|experto|врач|врачу|врачом|специалист|специалисту|специалистом|эксперт|医師|専門家|専門|お医者"
    ),
    "ask": "ask|consult|consulting|contact|speak to|speak with|talk to|see a|seek|turn to|refer to|reach out|询问|咨询|请教|去问|问|找|联系|求助|就医|就诊|consulter|adressez|demandez|contactez|fragen|wenden|konsultieren|consulte|consultar|pregunte|acuda|обратитесь|спросите|проконсультируйтесь|ご相談|相談|お問い合わせ|尋ね",
    # politeness
    "polite": (
        "sorry|apologies|apologize|apologise|unfortunately|regret|afraid|thank you|thanks|please|hello|hi|dear|feel free|let me know|anything else|understanding|understand|i hope|appreciate|forgive|pardon|excuse|with respect|"
        "抱歉|对不起|不好意思|遗憾|感谢|谢谢|您好|你好|亲|见谅|谅解|理解|原谅|包涵|如有|随时|其他需要|其它需要|需要|请|海涵|体谅|"
        "désolé|désolée|merci|malheureusement|pardon|excusez|regrette|leider|entschuldigung|tut mir leid|danke|bedaure|verzeihung|bitte|lo siento|gracias|disculpe|lamentablemente|lamento|perdón|por favor|"
        "извините|к сожалению|простите|спасибо|сожалею|пожалуйста|申し訳|すみません|恐れ入り|ご了承|ごめんなさい|残念|ありがとう|恐縮"
    ),
    # who speaks
    "self": "i|i'm|i am|i'd|i would|we|we're|me|my|this|that|it|these|those|there|such|the request|your request|your question|this assistant|我|本人|我们|本助手|我这边|这边|小编|je|nous|ich|wir|yo|nosotros|я|мы|私|当方|こちら|わたし",
    # who is spoken to, or of
    "other": "you|your|they|he|she|patient|patients|people|children|person|您|你|患者|病人|孩子|孕妇|老人|家属|大家|vous|patients|sie|patienten|usted|pacientes|вы|пациент|пациентам|あなた|患者",
    # words that say nothing by themselves
    "filler": (
        "a|an|the|to|of|on|in|for|with|at|by|from|as|is|are|be|am|have|has|do|does|not|and|or|but|so|about|regarding|concerning|kind|kinds|sort|question|questions|request|requests|topic|topics|subject|matter|matters|issue|thing|things|any|just|only|really|simply|here|now|"
        "currently|would|will|need|needs|better|best|should|may|might|then|if|because|since|which|what|how|one|some|however|though|therefore|reason|reasons|still|also|more|instead|sure|rather|must|can|could|like|want|"
        "的|了|是|就|这|那|此|该|对|在|和|与|也|都|还|会|可以|问题|请求|话题|内容|事|事情|情况|方面|相关|任何|目前|现在|因为|所以|因此|由于|只是|一个|一种|类|种|个|您的|你的|这个|这类|这件|这样|吧|呢|啊|哦|哈|作为|出于|考虑|安全|法律|隐私|合规|不过|但是|但|而|还是|最好|建议|去|来|之内|以内|里|中|上|人|"
        "que|de|la|le|les|des|du|à|cette|ce|question|sujet|pour|sur|cela|est|et|mais|avec|vous|un|une|votre|der|die|das|diese|dieser|dieses|diesem|frage|thema|zu|dabei|dazu|hierzu|damit|mir|es|ist|und|aber|über|ihnen|dir|"
        "el|los|las|esta|este|esa|ese|eso|esto|pregunta|tema|con|para|sobre|es|y|pero|en|se|на|это|этот|эту|этим|вопрос|вопросу|с|об|о|в|и|но|вам|вам|тему|その|この|ご質問|質問|には|について|に関して|は|が|を|に|の|こと|で|も"
    ),
}

#: Templates: classes in order.
TEMPLATES = [
    ("not", "act"), ("act", "not"), ("decline",), ("out", "range"), ("range", "out"), ("let", "else"), ("against", "rule"), ("rule", "against"), ("rule", "not"), ("unknown",),
    ("ai", "unknown"), ("self", "ask", "who"), ("filler", "ask", "who"), ("not", "range"),
]
#: Unknown words that a topic may have beside a template, and that a hint or politeness may have.
TOPIC, ASIDE = 14, 8
_WIDE = re.compile(r"[぀-ヿ㐀-鿿]")
_SENTENCE = re.compile(r"[。！？!?；;\n]+|\.(?=\s|$)")
_CLAUSE = re.compile(r"[，,：:、—–]+|\s-\s")
_PIECE = re.compile(r"[぀-ヿ㐀-鿿]+|[^\W_぀-ヿ㐀-鿿]+(?:'[^\W_぀-ヿ㐀-鿿]+)*")
_DIGIT = re.compile(r"\d")


@lru_cache(maxsize=1)
def _automaton():
    """Words of spaced scripts have a space at either end, so that only whole ones are found."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for cls, words in LEXICON.items():
        for w in words.split("|"):
            key = spaced(w)
            if key not in a:
                a.add_word(key.strip() if _WIDE.search(w) else key, (cls, len(key.strip() if _WIDE.search(w) else key)))
    a.make_automaton()
    return a


def spaced(clause: str) -> str:
    """The words of a clause, each with a space on both sides."""
    return " " + "  ".join(_PIECE.findall(clause)) + " "


def classes(clause: str) -> list[str]:
    """The classes of a lower-case clause in order, unknown words as "?"."""
    out: list[str] = []
    text, at = spaced(clause), 0
    for end, (cls, n) in _automaton().iter_long(text):
        if end + 1 - n > at:
            out += ["?"] * _count(text[at : end + 1 - n])
        out.append(cls)
        at = end + 1
    if at < len(text):
        out += ["?"] * _count(text[at:])
    return out


def _count(rest: str) -> int:
    """Unknown words: two characters of a wide script are about one."""
    return sum((len(w) + 1) // 2 if _WIDE.match(w) else 1 for w in rest.split())


def aligned(template: tuple[str, ...], seq: list[str]) -> list[int] | None:
    """The longest common subsequence of a template and a clause: its last places in the clause if it is the whole
    template, otherwise None."""
    rows = [[0] * (len(seq) + 1)]
    for t in template:
        row, above = [0], rows[-1]
        for k, s in enumerate(seq):
            row.append(above[k] + 1 if s == t else max(above[k + 1], row[k]))
        rows.append(row)
    if rows[-1][-1] < len(template):
        return None
    out, k = [], len(seq)
    for i in range(len(template), 0, -1):
        while rows[i][k - 1] == rows[i][k]:
            k -= 1
        k -= 1
        out.append(k)
    return out[::-1]


def refuses(seq: list[str], wide: bool) -> bool:
    """Whether a clause refuses."""
    here = set(seq)
    for t in TEMPLATES:
        if not here.issuperset(t):
            continue
        at = aligned(t, seq)
        if at is None:
            continue
        if t in (("not", "act"), ("act", "not")):
            # the last "not" before the act, near to it, and nobody else as its subject
            pairs = [(i, j) for i, s in enumerate(seq) if s == t[0] for j in range(i + 1, min(i + 7, len(seq))) if seq[j] == t[1] and seq[i + 1 : j].count("?") <= 2]
            for i, _ in pairs:
                head = seq[:i] if t[0] == "not" else []
                if "other" in head or head.count("?") > (4 if wide or "self" in head or "rule" in head else 0):
                    continue
                if seq.count("?") <= TOPIC:
                    return True
            continue
        if seq.count("?") <= (2 if t == ("unknown",) else 4 if len(t) > 1 else 6):
            return True
    return False


def _sentences(text: str) -> Iterator[str]:
    at = 0
    for m in _SENTENCE.finditer(text):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


def is_refusal(text: str) -> bool:
    low = text.lower().replace("’", "'")
    found = False
    for sentence in _sentences(low):
        aside: list[list[str]] = []
        here = False
        for clause in _CLAUSE.split(sentence):
            if not _PIECE.search(clause):
                continue
            seq = classes(clause)
            if refuses(seq, bool(_WIDE.search(clause))):
                here = True
                continue
            if _DIGIT.search(clause):
                return False
            known = set(seq) - {"?", "filler", "self", "other", "not", "act"}
            if seq.count("?") > (ASIDE if known else 4):
                return False
            aside.append(seq)
        if not here and any(set(seq).isdisjoint(("polite", "who", "ask", "else", "rule", "ai", "range")) for seq in aside):
            return False
        found |= here
    return found
