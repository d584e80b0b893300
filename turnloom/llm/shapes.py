"""Letters of the same shape in several scripts; what the Unicode database doesn't say."""

# Letters of one shape, by script; the letter of the other script first.
SAME_SHAPE = {
    "Cyrillic": "аa еe оo рp сc уy хx ѕs іi јj һh ӏl ԁd ԛq ԝw АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ ӀI ԚQ ԜW кκ",
    "Greek": "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX αa οo ρp νv ϳj ιi γy",
    "Armenian": "օo ՕO ոn սu հh յj ցg զq",
    "Cherokee": "ᎪA ᎠD ᎡR ᎢT ᎬE ᎳW ᎷM ᎻH ᎽY ᏀG ᏃZ ᏚS ᏙV ᏞL ᏟC ᏢP ᏦK ᏴB",
    "Coptic": "ⲞO ⲟo ⲤC ⲥc ⲢP ⲣp ⲎH ⲔK ⲘM ⲚN ⲦT ⲬX",
    "Latin": "ɡg ɑa ᴄc ᴏo ᴠv ᴡw ᴢz ꜱs",
    "Kana and ideographs": "ヘへ ロ口 ニ二 カ力 エ工 タ夕 ト卜 ハ八",
}
PAIRS = [tuple(p) for v in SAME_SHAPE.values() for p in v.split() if len(p) == 2]


def lower_shapes() -> dict[str, str]:
    """Lower-case Cyrillic and Greek letters with the Latin ones that either case looks like; where both cases do, the
    lower one counts."""
    own = [p for s in ("Cyrillic", "Greek") for p in SAME_SHAPE[s].split() if p[1].isascii()]
    out = {p[0].lower(): p[1].lower() for p in own if p[0].isupper()}
    return out | {p[0]: p[1] for p in own if p[0].islower()}
