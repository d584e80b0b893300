"""Refusals worded for this test: none of them is in a table or in the lexicon as a whole."""

from turnloom.llm.refusals import LEXICON, aligned, classes, is_refusal

REFUSALS = [
    "I'm sorry, but I cannot answer that. Questions of this kind need a qualified doctor.",
    "I can't help with that. I must decline to answer.",
    "Unfortunately I am not able to discuss medication doses with you.",
    "Thanks for asking, but giving medical opinions is beyond what I can do here.",
    "I won't comment on this.",
    "As a language model I don't know anything about this matter.",
    "Sorry, our policy forbids replies to questions like this one.",
    "I'd prefer not to talk about it. Is there anything else you need?",
    "This topic is off limits for me.",
    "We are unable to process your request at this time. Thank you for your understanding.",
    "My instructions don't allow me to provide that information.",
    "I have to pass on this one.",
    "I respectfully decline.",
    "Regrettably, I'm not in a position to advise you about surgery. Please speak to a specialist.",
    "It is not possible for me to respond to this.",
    "That lies outside my area of expertise.",
    "Shall we talk about something different?",
    "No idea, sorry.",
    "I refuse to take part in this.",
    "Answering this would violate my guidelines, so I will not do so.",
    "Due to privacy reasons, I can't share anything on that.",
    "I am not qualified to judge this. Please consult a physician.",
    "对不起，我没办法回答您的提问。",
    "很抱歉，这方面的问题我不方便回答，请您咨询医生。",
    "本助手无权处理此类请求。",
    "这个我真的不知道。",
    "抱歉，我不能给您任何诊断意见。建议去医院找专业医师。",
    "不好意思，这不属于我的业务范围。",
    "按照规定，我不可以透露这些内容。",
    "这题我答不上来。",
    "对此我只能保持沉默，望您谅解。",
    "作为语言模型，我对此不了解，帮不了您。",
    "您的请求违反了平台的使用政策，我拒绝执行。",
    "这种事我爱莫能助。",
    "我们换个话题聊聊吧。",
    "请恕我无法作答。",
    "由于政策限制，我暂时不能提供这类服务。",
    "我没有权限替您办理，抱歉。",
    "Désolé, je ne suis pas en mesure de répondre à votre demande.",
    "Je ne peux malheureusement pas donner d'avis médical.",
    "Je refuse de parler de ce sujet.",
    "Cela dépasse mes compétences.",
    "Es tut mir leid, aber darüber darf ich nicht sprechen.",
    "Leider kann ich Ihnen dazu keine Auskunft geben.",
    "Das liegt außerhalb meiner Möglichkeiten.",
    "Ich muss diese Anfrage ablehnen.",
    "Lo siento, no puedo dar consejos sobre ese tema.",
    "No me es posible contestar a su consulta.",
    "Me niego a responder.",
    "Eso está fuera de mi alcance.",
    "К сожалению, я не могу дать вам совет по этому вопросу.",
    "Извините, это выходит за рамки моих возможностей.",
    "Я отказываюсь обсуждать эту тему.",
    "Не знаю.",
    "申し訳ありませんが、そのご質問には回答できません。",
    "恐れ入りますが、対応いたしかねます。",
    "この件についてはお答えを控えさせていただきます。",
    "すみません、それについては分かりません。",
    "I'm afraid there is nothing I can do to assist you with this.",
    "Could you ask somebody else? I am not allowed to help here.",
]

ANSWERS = [
    "抱歉回复晚了。建议先到骨科做血常规，再决定要不要用药。",
    "虽然无法一概而论，但是可以这样理解：饮食以清淡为主，忌辣椒。",
    "As an AI I may miss details, yet here is a full answer. Try bed rest for ten days.",
    "不能自行停用药物。", "可能是偏头痛", "You can't give aspirin to small children.", "Patients cannot stop the tablets overnight, because reflux tends to return.",
    "I can't see your scan, but swelling after a fall usually goes down within a week if you rest and cool the ankle.",
    "没有大碍，多喝水。", "不会传染。", "Sorry for the delay. Take one tablet after breakfast.", "不可以喝酒", "No.", "Not before the wound has closed.", "Il ne peut pas marcher avant trois semaines.",
    "Das Mittel darf nicht mit Milch eingenommen werden.", "No puede comer pescado crudo durante el embarazo.", "Нельзя мочить повязку два дня.", "お酒は飲めません。", "单靠热敷无法根治贫血，还要配合药物。",
    "The thyroid panel looks normal, although eczema can't be ruled out.", "如果持续两周以上，应当尽早去医院就诊。", "Ask for a blood test and drink more water.", "This is beyond doubt a harmless wart.", "",
]


def test_refusals_of_own_wording():
    missed = [t for t in REFUSALS if not is_refusal(t)]
    assert len(missed) <= 0.1 * len(REFUSALS), missed


def test_answers():
    assert [t for t in ANSWERS if is_refusal(t)] == []


def test_no_refusal_is_in_the_lexicon():
    words = {w for v in LEXICON.values() for w in v.split("|")}
    assert not any(t.lower().strip(".。") in words for t in REFUSALS if t != "Не знаю.")


def test_length_does_not_matter():
    long = "I'm sorry. " * 40 + "I cannot answer that. " + "Thank you for your understanding. " * 40
    assert is_refusal(long) and not is_refusal(long + "Take two tablets with plenty of water after each meal today.")


def test_alignment():
    assert aligned(("not", "act"), ["self", "not", "?", "act"]) == [1, 3] and aligned(("not", "act"), ["act", "not"]) is None
    assert classes("i cannot answer that") == ["self", "not", "act", "self"]
