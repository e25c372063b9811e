"""Turkish documents derived from the test documents, which hold none: sentences of our own, dealt by id and length.

A document gets a sentence for every ``SHARE`` characters of its text, and at least one; every fifth starts a
paragraph. The SQL side deals the same sentences by the same sums, so that rules about Turkish can be compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from berrak.functions.arrays import let

SHARE = 60
SENTENCES = [
    "Köye yirmi beş fidan geldi.", "Oraya yirmi otuz kişi geldi.", "Bize iki yüz elli dört koli verdiler.", "Depoda bir milyon üç yüz bin tuğla var.", "Üç dört yüz metre yürüdük.", "Bin beş yüz kişi yarışa katıldı.", "Sekiz kişi evde kaldı.", "On bir gün sonra döndük.", "Kırk yedi, elli altı diye saydı.",
    "Kadınların %35'i işe başladı.", "Fiyatlar %20 arttı.", "Ormanın yüzde 40 kadarı yandı.", "Kiralar yüzde 12 yükseldi.", "Çocukların %3,5 kadarı hasta oldu.", "Tarlanın 3/4 kadarı ekildi.", "Öğrencilerin ücretinden %15 indirim yaptılar.", "Nüfusun %8'i göçtü, faizler %9 oldu.",
    "Kapı 08.30 gibi açılır.", "Otobüs saat 14.45 olunca kalkar.", "Kurs 09.00-12.30 arasında sürer.", "Süt 4.50 lira oldu.", "Film 21:15 gibi başlar.", "Saat 10.00 ile 11.30 arasında bekledik.",
    "Ali (dün gelen) komşuyu gördü.", "Eve (bahçeye (arka tarafa) bakan) girdik.", 'Annem "hemen gelin" dedi.', '"Kapıyı kapatmayın."', 'Tabelada "girilmez" yazıyor.', "Yarım kalan ( iş bitti.", "Fazla olan ) silindi.",
    "Bu tebliğin örneğini bize verdiler.", "Tebliği okuduk, tebliğ uzundu.", "Muhtarlığa arz ettiler.", "Komşular websitesini gördü.", "Linkleri bize yolladı, linke bastık.", "Kitabı okudum, kitabın adı güzeldi.", "Kitaplıktan bir kitap aldım.", "Çorbayı ocağa koydu.", "Ocakta süt var, ocak sıcak.",
]
#: A lexicon of our own whose entries take endings.
BENT = {
    "jargon": [{"ifade": "tebliğ", "oneri": "bildirim"}, {"ifade": "arz etmek", "oneri": "sunmak"}, {"ifade": "kitap", "oneri": "yapıt"}, {"ifade": "ocak", "oneri": "fırın"}],
    "yabanci": [{"kelime": "link", "oneri": "bağlantı"}, {"kelime": "websitesi", "oneri": "ağ sayfası"}],
}


def turkish_text(doc_id: Column, text: Column) -> Column:
    """The Turkish text of a document. A null text counts as empty. Its length is worked out once, not for every sentence."""
    return let(F.length(F.coalesce(text, F.lit(""))), lambda n: _dealt(doc_id, n))


def _dealt(doc_id: Column, n: Column) -> Column:
    """The sentences of a document of n characters."""
    several = F.sequence(F.lit(0), F.floor(n / SHARE).cast("int"))
    which = lambda k: (F.pmod(doc_id * 31 + n + k.cast("long") * 7, F.lit(len(SENTENCES))) + 1).cast("int")
    said = lambda k: F.concat(F.when(k == 0, "").when(k % 5 == 0, "\n\n").otherwise(" "), F.element_at(F.array(*map(F.lit, SENTENCES)), which(k)))
    return F.array_join(F.transform(several, said), "")


def turkish_documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", turkish_text(F.col("doc_id"), F.col("text")).alias("text"))
