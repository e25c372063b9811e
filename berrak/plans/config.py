"""Profiles, lexicons and the registry of rules: small settings that live on the driver."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

SEVERITIES = ("hata", "uyarı", "bilgi")
CATEGORIES = ("cümle", "kelime", "biçim", "metin")
#: Other spellings of a severity.
ALIASES = {"error": "hata", "warning": "uyarı", "uyari": "uyarı", "info": "bilgi", "warn": "uyarı"}
WEIGHTS = {"hata": 3.0, "uyarı": 1.0, "bilgi": 0.25}


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class RuleConfig:
    enabled: bool = True
    severity: str | None = None
    params: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Profile:
    name: str
    k: float
    weights: Mapping[str, float]
    rules: Mapping[str, RuleConfig]

    def config(self, rule: str) -> RuleConfig:
        return self.rules.get(rule, RuleConfig())

    def param(self, rule: str, name: str, default: Any) -> Any:
        return self.config(rule).params.get(name, default)


#: Thresholds of the two built-in profiles, as (easy language, plain language).
THRESHOLDS = {
    "KD-C01": {"warn_above": (10, 15), "error_above": (15, 22)},
    "KD-C02": {"max_predicates": (1, 2)},
    "KD-C06": {"threshold": (2, 3)},
    "KD-C07": {"threshold": (2, 3)},
    "KD-C08": {"chain": (3, 4)},
    "KD-C10": {"max_gap": (6, 10)},
    "KD-K04": {"max_syllables": (4, 5), "max_suffixes": (3, 4)},
    "KD-B01": {"min_value": (10, 1000)},
    "KD-B04": {"suggest_weekday": (True, False)},
    "KD-B06": {"max_colons": (1, 1)},
    "KD-B07": {"max_words": (3, 3)},
    "KD-M01": {"max_sentences": (5, 8)},
    "KD-M02": {"min_words": (150, 150)},
    "KD-M03": {"min_items": (4, 4)},
    "KD-M04": {"first_fraction": (0.3, 0.3)},
    "KD-M05": {"max_words": (400, 400)},
}
#: Severities that differ from a warning, and rules that are off, in each profile.
EASY = {"severity": {"KD-C05": "hata", "KD-C10": "bilgi", "KD-K06": "bilgi", "KD-B03": "bilgi", "KD-B08": "bilgi", "KD-M02": "bilgi", "KD-M04": "bilgi", "KD-M05": "bilgi"}, "off": ()}
PLAIN = {
    "severity": {**EASY["severity"], **dict.fromkeys(("KD-C04", "KD-K02", "KD-K04", "KD-K05", "KD-K07", "KD-K08", "KD-B01", "KD-B02", "KD-B04", "KD-B05", "KD-M03"), "bilgi")},
    "off": ("KD-K06", "KD-B03", "KD-B08", "KD-M05"),
}
RULE_IDS = [f"KD-C{k:02d}" for k in range(1, 12)] + [f"KD-K{k:02d}" for k in range(1, 9)] + [f"KD-B{k:02d}" for k in range(1, 9)] + [f"KD-M{k:02d}" for k in range(1, 6)]


def _builtin(name: str, k: float, own: Mapping[str, Any], which: int) -> Profile:
    rules = {}
    for rule in RULE_IDS:
        params = {p: v[which] for p, v in THRESHOLDS.get(rule, {}).items()}
        severity = own["severity"].get(rule, None if rule == "KD-C01" else "uyarı")
        rules[rule] = RuleConfig(rule not in own["off"], severity, params)
    return Profile(name, k, dict(WEIGHTS), rules)


PROFILES = {"kolay-dil": _builtin("kolay-dil", 0.6, EASY, 0), "sade-dil": _builtin("sade-dil", 0.5, PLAIN, 1)}


def severity(value: str | None) -> str | None:
    if value is None:
        return None
    found = ALIASES.get(value.lower(), value.lower())
    if found not in SEVERITIES:
        raise ConfigError(f"unknown severity: {value}")
    return found


def load_profile(source: str | Path | Mapping[str, Any] | Profile, depth: int = 0) -> Profile:
    """A built-in profile by name, or one from YAML or a mapping; ``extends`` may chain five deep."""
    if isinstance(source, Profile):
        return source
    if isinstance(source, str) and source in PROFILES:
        return PROFILES[source]
    if depth > 5:
        raise ConfigError("profiles extend one another in a circle, or too deep")
    raw: Any = source
    folder = Path()
    if not isinstance(source, Mapping):
        import yaml

        path = Path(source)
        folder = path.parent
        try:
            raw = yaml.safe_load(path.read_text(encoding="utf-8"))
        except (OSError, yaml.YAMLError) as error:
            raise ConfigError(f"profile can't be read: {source}") from error
    if not isinstance(raw, Mapping):
        raise ConfigError("a profile is a mapping")
    up = raw.get("extends")
    parent = load_profile(up if isinstance(up, str) and up in PROFILES else folder / up if isinstance(up, str) else up, depth + 1) if up else Profile("", 0.6, dict(WEIGHTS), {})
    rules = dict(parent.rules)
    for rule, own in (raw.get("rules") or {}).items():
        if rule not in RULE_IDS:
            raise ConfigError(f"unknown rule: {rule}")
        old = rules.get(rule, RuleConfig())
        rules[rule] = RuleConfig(own.get("enabled", old.enabled), severity(own.get("severity")) or old.severity, {**old.params, **(own.get("params") or {})})
    weights = {**parent.weights, **{severity(k): float(v) for k, v in (raw.get("weights") or {}).items()}}
    return Profile(raw.get("name", parent.name or "custom"), float(raw.get("compliance_k", parent.k)), weights, rules)


#: Sections of a lexicon.
SECTIONS = ("jargon", "yabanci", "deyimler", "belirsiz", "kisaltmalar", "es_anlamlilar", "dolayli_hitap", "sik_kelimeler", "bilinen")
#: A lexicon of our own, to start with: words that offices use and what to say instead.
STARTER: dict[str, list[Any]] = {
    "jargon": [{"ifade": a, "oneri": b} for a, b in (
        ("müracaat", "başvuru"), ("tebliğ", "bildirim"), ("ibraz", "gösterme"), ("mezkur", "adı geçen"), ("ivedilikle", "hemen"), ("ivedi", "acele"),
        ("arz etmek", "sunmak"), ("ikame etmek", "yerine koymak"), ("ikamet etmek", "oturmak"), ("ikametgah", "oturulan yer"),
        ("tahakkuk", "hesaplama"), ("tahsil etmek", "almak"), ("tevdi etmek", "vermek"), ("temin etmek", "sağlamak"), ("tesis etmek", "kurmak"),
        ("tanzim etmek", "düzenlemek"), ("ihdas etmek", "kurmak"), ("iktisap etmek", "edinmek"), ("intikal etmek", "ulaşmak"),
        ("ifa etmek", "yerine getirmek"), ("ihtar", "uyarı"), ("muhatap", "ilgili kişi"), ("mükellef", "yükümlü"), ("müteakip", "sonraki"),
        ("müteakiben", "sonra"), ("mevzuat", "kurallar"), ("mahal", "yer"), ("mezuniyet", "bitirme"), ("nezdinde", "yanında"),
        ("ilgi yazı", "yazınız"), ("işbu", "bu"), ("bilahare", "sonra"), ("binaen", "göre"), ("binaenaleyh", "bu yüzden"), ("derhal", "hemen"),
        ("hasebiyle", "nedeniyle"), ("haiz olmak", "sahip olmak"), ("istinaden", "dayanarak"), ("keyfiyet", "durum"), ("mahsup etmek", "düşmek"),
        ("marifetiyle", "eliyle"), ("muvafakat", "izin"), ("mütalaa", "görüş"), ("mutabakat", "anlaşma"), ("refakat", "eşlik"),
        ("sarf etmek", "harcamak"), ("sehven", "yanlışlıkla"), ("şahsen", "kendiniz"), ("talep etmek", "istemek"), ("tekemmül", "tamamlanma"),
        ("teslim etmek", "vermek"), ("vuku bulmak", "olmak"), ("yekun", "toplam"), ("zilyetlik", "elinde tutma"), ("addetmek", "saymak"),
        ("akabinde", "ardından"), ("bedel", "ücret"), ("bertaraf etmek", "gidermek"), ("cebri", "zorla"), ("emsal", "benzer"), ("fesih", "bozma"),
        ("hülasa", "özet"), ("icra", "uygulama"),
    )],
    "yabanci": [{"kelime": a, "oneri": b} for a, b in (
        ("link", "bağlantı"), ("feedback", "geri bildirim"), ("online", "internetten"), ("offline", "internetsiz"), ("prosedür", "işlem yolu"),
        ("revize", "yenileme"), ("revizyon", "yenileme"), ("deadline", "son gün"), ("workshop", "atölye"), ("trend", "eğilim"), ("data", "veri"),
        ("e-mail", "e-posta"), ("mail", "e-posta"), ("check-in", "giriş"), ("network", "ağ"), ("spesifik", "belirli"), ("optimize", "en iyi"),
        ("organize etmek", "düzenlemek"), ("koordinasyon", "eşgüdüm"), ("koordine", "eşgüdümlü"), ("entegre", "bütünleşik"),
        ("entegrasyon", "bütünleşme"), ("implementasyon", "uygulama"), ("perspektif", "bakış"), ("konsept", "kavram"), ("prezantasyon", "sunum"),
        ("rezerve", "ayrılmış"), ("start almak", "başlamak"), ("full", "tam"), ("background", "arka plan"), ("download", "indirme"),
        ("upload", "yükleme"), ("update", "güncelleme"), ("customer", "müşteri"), ("motivasyon", "istek"), ("adaptasyon", "uyum"), ("absürt", "saçma"),
        ("anons", "duyuru"), ("departman", "bölüm"), ("determine", "belirli"), ("dizayn", "tasarım"), ("efektif", "etkili"), ("enteresan", "ilginç"),
        ("ekipman", "donanım"), ("handikap", "engel"), ("kriter", "ölçüt"), ("lokasyon", "yer"), ("minimum", "en az"), ("maksimum", "en çok"),
        ("opsiyon", "seçenek"), ("partner", "ortak"), ("periyot", "dönem"), ("potansiyel", "gizli güç"), ("provoke", "kışkırtma"),
        ("sirkülasyon", "dolaşım"), ("sponsor", "destekçi"), ("transfer", "aktarma"), ("vizyon", "görüş"),
    )],
    "deyimler": [{"ifade": x} for x in (
        "göz ardı etmek", "göz önünde bulundurmak", "göz yummak", "el atmak", "el koymak", "ele almak", "masaya yatırmak", "kulak vermek",
        "kulak asmak", "ayak uydurmak", "baş göstermek", "can atmak", "dile getirmek", "gündeme gelmek", "hayata geçirmek", "ışık tutmak",
        "kaleme almak", "mercek altına almak", "nokta koymak", "önünü açmak", "rafa kaldırmak", "sekte vurmak", "taviz vermek", "üstesinden gelmek",
        "yol açmak", "zemin hazırlamak", "devreye girmek", "devre dışı bırakmak", "kapı aralamak", "boyun eğmek", "çığır açmak", "dirsek çürütmek",
        "gözden kaçmak", "gözden geçirmek", "ipe un sermek", "kafa yormak", "köprü kurmak", "taşın altına elini koymak", "yüzüne bakmak",
        "suya düşmek", "altını çizmek", "çıkmaza girmek", "eli kulağında", "gözden çıkarmak", "iş işten geçmek", "kolları sıvamak", "pes etmek",
        "sırt çevirmek", "yan çizmek",
    )],
    "belirsiz": [{"ifade": x} for x in (
        "en kısa sürede", "en kısa zamanda", "birtakım", "yakında", "yakın zamanda", "gerekli belge", "gerekli belgeler", "gerekli işlem",
        "gerekli tedbir", "ilgili birim", "ilgili makam", "ilgili kişi", "ilgili yer", "bazı durumlarda", "bazı hallerde", "uygun görülen",
        "uygun bir zamanda", "makul bir süre", "makul süre", "belirli bir süre", "belli bir süre", "bir süre", "bir an önce", "mümkün olduğunca",
        "mümkünse", "gerektiğinde", "gerekirse", "gerek görülmesi halinde", "zaman zaman", "ara sıra", "genellikle", "çoğunlukla", "yaklaşık olarak",
        "aşağı yukarı", "çeşitli nedenlerle", "teknik nedenlerle", "ileri bir tarihte", "ilerleyen günlerde", "önümüzdeki günlerde",
        "belirlenecek tarihte", "yeterli sayıda", "yeterli miktarda", "çok sayıda",
    )],
    "kisaltmalar": [
        {"kisaltma": "TBMM", "acilim": "Türkiye Büyük Millet Meclisi", "bilinir": True}, {"kisaltma": "TC", "bilinir": True}, {"kisaltma": "TL", "bilinir": True}, {"kisaltma": "KDV", "acilim": "katma değer vergisi"},
        {"kisaltma": "SGK", "acilim": "Sosyal Güvenlik Kurumu"}, {"kisaltma": "PTT", "bilinir": True}, {"kisaltma": "TRT", "bilinir": True}, {"kisaltma": "MEB", "acilim": "Millî Eğitim Bakanlığı"}, {"kisaltma": "SMS", "bilinir": True},
    ],
    "es_anlamlilar": [
        {"grup": ["doktor", "hekim", "tabip"]}, {"grup": ["başvuru", "müracaat"]}, {"grup": ["öğrenci", "talebe"]}, {"grup": ["ücret", "bedel"]}, {"grup": ["okul", "mektep"]},
        {"grup": ["ev", "konut", "mesken"]}, {"grup": ["mahkeme", "adliye"]}, {"grup": ["yasa", "kanun"]}, {"grup": ["süre", "müddet"]}, {"grup": ["belge", "evrak", "vesika"]},
    ],
    # iz: of which every match holds one, whatever the case; patterns without it are always looked for
    "dolayli_hitap": [
        {"desen": "(?:(?:ilgililere|kamuoyuna|halkımıza)\\s+)?(?:(?:saygıyla|önemle)\\s+)?duyurulur", "ad": "duyuru", "iz": ["duyurulur"]}, {"desen": "(?:(?:önemle|saygıyla)\\s+)?(?:rica|arz|talep)\\s+olun(?:ur|maktadır)", "ad": "rica", "iz": ["olun"]},
        {"desen": "gerekmektedir", "ad": "gereklilik", "iz": ["gerekmektedir"]}, {"desen": "vatandaşlarımızın\\s+bilgisine", "ad": "bilgi", "iz": ["bilgisine"]}, {"desen": "tarafınız(?:ca|dan|a)", "ad": "taraf", "iz": ["tarafınız"]}, {"desen": "ilgililerin\\s+dikkatine", "ad": "dikkat", "iz": ["dikkatine"]},
        {"desen": "(?:zorunludur|mecburidir|yükümlüdür(?:ler)?|zorundadır(?:lar)?)", "ad": "zorunluluk", "iz": ["zorun", "mecburidir", "yükümlüdür"]}, {"desen": "zorunluluğu\\s+(?:vardır|bulunmaktadır)", "ad": "zorunluluk", "iz": ["zorunluluğu"]},
        {"desen": "(?:başvuru|hak)\\s+sahip(?:leri|lerinin|lerine)", "ad": "sahip", "iz": ["sahip"]}, {"desen": "başvuru\\s+sahibi(?:nin|ne)?", "ad": "sahip", "iz": ["sahibi"]},
        {"desen": "(?:vatandaşlarımız|müşterilerimiz|yolcularımız|üyelerimiz|öğrencilerimiz)(?:in|ın)?(?![\\p{L}])", "ad": "seslenilenler", "iz": ["ımız", "imiz"]},
    ],
    "sik_kelimeler": [],
    "bilinen": [],
}


def load_lexicon(source: str | Path | Mapping[str, Any] | None = None) -> dict[str, list[Any]]:
    """The starter lexicon with the sections of a YAML file or mapping added to it."""
    out = {k: list(v) for k, v in STARTER.items()}
    raw: Any = source
    if isinstance(source, str | Path):
        import yaml

        try:
            raw = yaml.safe_load(Path(source).read_text(encoding="utf-8"))
        except (OSError, yaml.YAMLError) as error:
            raise ConfigError(f"lexicon can't be read: {source}") from error
    if raw is None:
        return out
    if not isinstance(raw, Mapping):
        raise ConfigError("a lexicon is a mapping of sections")
    if unknown := set(raw) - set(SECTIONS):
        raise ConfigError(f"unknown sections: {', '.join(sorted(unknown))}")
    for section, items in raw.items():
        out[section] += list(items or [])
    return out
