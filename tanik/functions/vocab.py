"""The Turkish word lists, patterns and names that the jobs use unless others are passed."""

from __future__ import annotations

# --- fixed values: words that carry no topic, and words read as another word
STOP_WORDS = tuple("bir ve ile de da icin bu olan olarak daha haber son dakika sonra once gore kisi kisinin".split())
SYNONYMS = {
    "carpisti": "kaza", "carpismasi": "kaza", "kazasi": "kaza", "kazada": "kaza",
    "yaralandi": "yarali", "yaralanan": "yarali", "yaralilar": "yarali",
    "yolunda": "yol", "yolu": "yol", "karayolu": "yol", "karayolunda": "yol",
    "ulasim": "trafik", "ulasimi": "trafik", "aksatti": "kapali", "kapandi": "kapali",
    "yangini": "yangin", "depremi": "deprem", "gozaltina": "gozalti", "gozaltinda": "gozalti",
    "secimleri": "secim", "macinda": "mac", "macini": "mac",
}

# --- fixed values: kinds of events, in order, over normalised text
EVENT_KINDS = (
    ("traffic_accident", r"\bkaza\b|carpis|zincirleme"),
    ("fire", "yangin"),
    ("earthquake", "deprem"),
    ("crime", "gozalti|tutukla|cinayet|saldiri"),
    ("sports", "mac|gol|futbol|basketbol"),
    ("politics", "secim|meclis|bakan|cumhurbaskani"),
)

# --- fixed values: news categories, in order, over normalised text
CATEGORIES = (
    ("spor", "spor|futbol|basketbol|voleybol|hentbol|tenis|judo|gures|milli takim|super lig|sampiyon|turnuva|grand prix|formula 1|mac|gol|transfer"),
    ("egitim", "egitim|okul|universite|sinav|ogrenci|ogretmen|atama|tercih|yerlestirme|yks|lgs|kpss|dgs|osym|meb|yok|burs|yurt"),
    ("ekonomi", "ekonomi|enflasyon|ihracat|ithalat|borsa|dolar|euro|faiz|vergi|butce|ticaret|piyasa|mukellef|yatirim|istihdam|maas|ucret"),
    ("yasam", "yasam|saglik|kultur|sanat|muzik|sinema|festival|teknoloji|bilim|cevre|turizm|seyahat|hava durumu|yemek|hastane|dogal hayat"),
    ("dunya", "rusya|ukrayna|abd|amerika|iran|israil|filistin|suriye|avrupa|almanya|fransa|ingiltere|italya|ispanya|cin|japonya|hindistan|nato|birlesmis milletler"),
)
HARD_NEWS = ("politics", "crime", "fire", "earthquake", "traffic_accident")
EDUCATION_SOURCES = ("osym", "meb", "yok", "yokak", "gsb")

# --- fixed values: wire agencies, in order, over normalised text
AGENCIES = (
    ("aa", r"\baa\b|anadolu ajansi"),
    ("dha", r"\bdha\b|demiroren haber ajansi"),
    ("iha", r"\biha\b|ihlas haber ajansi"),
    ("reuters", r"\breuters\b"),
    ("ap", "associated press"),
    ("anka", "anka haber ajansi"),
)

# --- fixed values: numbers and months as words (folded)
NUMBER_WORDS = {"sifir": 0, "bir": 1, "iki": 2, "uc": 3, "dort": 4, "bes": 5, "alti": 6, "yedi": 7, "sekiz": 8, "dokuz": 9, "on": 10}
MONTHS = ("ocak", "subat", "mart", "nisan", "mayis", "haziran", "temmuz", "agustos", "eylul", "ekim", "kasim", "aralik")

# --- fixed values: the provinces
CITIES = tuple(
    "Adana Adıyaman Afyonkarahisar Ağrı Amasya Ankara Antalya Artvin Aydın Balıkesir Bilecik Bingöl Bitlis Bolu Burdur Bursa "
    "Çanakkale Çankırı Çorum Denizli Diyarbakır Edirne Elazığ Erzincan Erzurum Eskişehir Gaziantep Giresun Gümüşhane Hakkâri "
    "Hatay Isparta Mersin İstanbul İzmir Kars Kastamonu Kayseri Kırklareli Kırşehir Kocaeli Konya Kütahya Malatya Manisa "
    "Kahramanmaraş Mardin Muğla Muş Nevşehir Niğde Ordu Rize Sakarya Samsun Siirt Sinop Sivas Tekirdağ Tokat Trabzon Tunceli "
    "Şanlıurfa Uşak Van Yozgat Zonguldak Aksaray Bayburt Karaman Kırıkkale Batman Şırnak Bartın Ardahan Iğdır Yalova Karabük "
    "Kilis Osmaniye Düzce".split()
)

# --- fixed values: named things as (kind, value, other spellings)
NAMED = (
    ("road", "ankara-eskisehir", ("ankara eskişehir yolu", "ankara eskişehir yolunda", "eskişehir yolu", "eskişehir yolunda")),
    ("road", "tem", ("tem otoyolu", "tem otoyolunda")),
    ("road", "d-100", ("d 100", "e 5 karayolu")),
    *(("district", None, (name,)) for name in ("Çankaya", "Keçiören", "Mamak", "Polatlı", "Sincan", "Kadıköy", "Beşiktaş", "Bornova")),
    *(("institution", None, (name,)) for name in ("AFAD", "KGM", "TBMM", "ÖSYM", "MEB", "İçişleri Bakanlığı", "Sağlık Bakanlığı")),
    *(("team", None, (name,)) for name in ("Galatasaray", "Fenerbahçe", "Beşiktaş", "Trabzonspor")),
)

# --- fixed values: what a sentence says in numbers: pattern, and the claim by a part of the normalised label
COUNT_CLAIMS = (
    (
        r"(?P<value>\d+|sıfır|bir|iki|üç|dört|beş|altı|yedi|sekiz|dokuz|on)\s+(?:(?:kişi|kişinin)\s+)?(?P<label>araç|otomobil|yaralı|yaralandı|yaralanan|öldü|ölü|hayatını kaybetti|gözaltına alındı)",
        (("arac", "vehicle_count"), ("otomobil", "vehicle_count"), ("yaral", "injury_count"), ("gozalti", "detention_count"), ("", "death_count")),
    ),
    (r"(?P<label>yaralı|ölü|can kaybı) sayısı(?:nın)?\s+(?P<value>\d+|iki|üç|dört|beş|altı|yedi|sekiz|dokuz|on)", (("yarali", "injury_count"), ("", "death_count"))),
)
#: Only in reports of an earthquake.
MAGNITUDE_CLAIM = (r"(?P<value>\d+[.,]\d+)\s+(?P<label>büyüklüğünde)", (("", "earthquake_magnitude"),))

# --- fixed values: what a normalised sentence says as yes or no
STATE_CLAIMS = (
    ("(?:yol|trafik|ulasim).*(?:kapandi|kapatildi|kapali)", "road_closed", "true"),
    ("(?:yol|trafik|ulasim).*(?:acildi|normale dondu)", "road_closed", "false"),
    ("yangin.*sonduruldu|olay.*sona erdi", "event_ended", "true"),
)
#: Words of a correction, over normalised text.
CORRECTION = "duzelt|guncelle|yukseldi|artti|azaldi|olarak aciklandi|normale dondu|trafige acildi"
#: When a text says that its event happened.
OCCURRED = r"(?:olay|kaza|deprem|yangın)[^\n.]{0,40}?(\d{1,2} [A-Za-zÇĞİÖŞÜçğıöşü]+ \d{4}(?: (?:saat )?\d{2}:\d{2})?)"
#: Kinds of entities that a sentence reports as a place.
PLACES = ("city", "district", "road", "location")
#: Claims that only the patterns above can make.
COUNTED = ("injury_count", "death_count", "vehicle_count", "detention_count", "earthquake_magnitude")

# --- fixed values: names by their form: pattern, and the kind of entity by the end of the name
NAME_FORMS = (
    (r"(?<![A-Za-z0-9_])([A-ZÇĞİÖŞÜ][a-zçğıöşü]+(?: [A-ZÇĞİÖŞÜ][a-zçğıöşü]+){1,2})\s+(?:açıkladı|dedi|konuştu|gözaltına)", (("", "person"),)),
    (
        r"(?<![A-Za-z0-9_])([A-ZÇĞİÖŞÜ][^\W\d_]+(?: [A-ZÇĞİÖŞÜ][^\W\d_]+){0,2} (?:Mahallesi|Caddesi|Sokağı|Köprüsü|Stadyumu|Partisi|Holding))",
        (("Partisi", "organization"), ("Holding", "organization"), ("", "location")),
    ),
)

# --- fixed values: titles of official results and of the preference period, with what they state
RESULT_TITLES = (
    (r"^([0-9]{4})-YKS:\s*Sınav Sonuçları Açıklandı$", "yks"),
    (r"^([0-9]{4})-YKS:\s*Yerleştirme Sonuçları Açıklandı$", "yks_yerlestirme"),
)
PREFERENCE_TITLE = r"^([0-9]{4})-YKS:\s*Tercihlerin Alınması$"
PREFERENCE_RANGE = (
    r"Adaylar tercihlerini,\s+(([0-9]{1,2})\s+(Ocak|Şubat|Mart|Nisan|Mayıs|Haziran|Temmuz|Ağustos|Eylül|Ekim|Kasım|Aralık)\s+([0-9]{4})\s*-\s*"
    r"([0-9]{1,2})\s+(Ocak|Şubat|Mart|Nisan|Mayıs|Haziran|Temmuz|Ağustos|Eylül|Ekim|Kasım|Aralık)\s+([0-9]{4}))\s+tarihleri arasında"
)
MONTH_NAMES = ("Ocak", "Şubat", "Mart", "Nisan", "Mayıs", "Haziran", "Temmuz", "Ağustos", "Eylül", "Ekim", "Kasım", "Aralık")

# --- fixed values: official announcements: blocks that are quoted, text that opens none, labels of action links
QUOTED_KINDS = ("paragraph", "list_item")
BOILERPLATE = r"^DUYURU\b|^ÖSYM BAŞKANLIĞI|^Adaylara ve kamuoyuna"
#: (host, word of the title, label), the first that fits; an empty word fits every title.
ACTION_LABELS = (
    ("sonuc.osym.gov.tr", "YKS", "YKS sonuçlarını görüntüle"),
    ("sonuc.osym.gov.tr", "", "Sonuçları görüntüle"),
    ("ykssonuc.osym.gov.tr", "YKS", "YKS sonuçlarını görüntüle"),
    ("ykssonuc.osym.gov.tr", "", "Sonuçları görüntüle"),
    ("ais.osym.gov.tr", "", "ÖSYM Aday İşlemleri’ne git"),
)
ACTION_WORDS = "sonuç|başvur|tercih|kılavuz"
