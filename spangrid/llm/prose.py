"""Natural language hidden in comments and string literals, told apart by compression.

For each language a zstandard dictionary is built from labelled text, and one more from code. A sentence is encoded with
the dictionaries of its script; the shortest encoding names the language, unless the code dictionary, or no dictionary
at all, comes within a margin of it.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import spread
from .arrow import slices
from .lexers import blanked, extension, span_pattern

LANGUAGES = ("en", "de", "fr", "es", "pt", "ru", "pl", "zh", "ja", "ko")
#: Labelled documents per language that the dictionaries are built from; bounds what the driver collects.
SAMPLE_ROWS = 300
#: Characters that a labelled document in that sample may have.
SAMPLE_CHARS = 20_000
#: Bytes of text in one dictionary.
DICTIONARY = 60_000
#: Level of the encoder; a high one finds the short matches that short sentences depend on.
LEVEL = 3
#: Words a sentence needs; characters in Chinese and Japanese.
MIN_WORDS, MIN_CHARS = 5, 8

# A few everyday sentences per language, so that a language that the labelled rows lack is known too.
SEEDS = {
    "en": "This is the place where we check whether the value is already there before the call. Please do not change it until the file has been read, because it may still be used. If there is an error, try again after a while and keep the result as it was. We have to make sure that both of them are not longer than the limit. It should be moved so that the next line is never lost when the user stops. This file belongs to the project and may be copied, used and shared under the rules in the license file. This file is part of the library; see the notice at the top of the tree for what is allowed. Copyright the authors and contributors of the software, all rights reserved. All parts of this file may be changed under the license terms, without any warranty. It was automatically created by the build step, so edits are overwritten and manual changes will be lost. It was produced and written by a tool from the schema; do not modify it by hand, run it again instead of editing. It was taken from the upstream release without changes, the copy is kept here as is, and patches are listed below. This is the output of a tool; the source of record is the definition and not this file. Third party code, see its own notice for the terms of use. It is a snapshot synced by a script, and the upstream project owns it.",
    "de": "Hier wird geprüft, ob der Wert schon vorhanden ist, bevor die Funktion aufgerufen wird. Bitte nicht ändern, solange die Datei noch gelesen wird, weil sie sonst nicht mehr stimmt. Wenn ein Fehler auftritt, muss man es später noch einmal versuchen und das Ergebnis behalten. Wir müssen darauf achten, dass beide nicht länger als die Grenze sind. Danach kann die nächste Zeile nicht verloren gehen.",
    "fr": "Ici on vérifie si la valeur est déjà présente avant d'appeler la fonction. Il ne faut pas la modifier tant que le fichier n'a pas été lu, car elle peut encore servir. En cas d'erreur, veuillez réessayer plus tard et garder le résultat tel quel. Nous devons nous assurer que les deux ne sont pas plus longs que la limite. Ensuite la ligne suivante ne peut pas être perdue.",
    "es": "Aquí se comprueba si el valor ya existe antes de llamar a la función. No hay que cambiarlo mientras el archivo no se haya leído, porque todavía puede usarse. Si hay un error, inténtelo de nuevo más tarde y guarde el resultado como estaba. Tenemos que asegurarnos de que los dos no sean más largos que el límite. Después la línea siguiente no se puede perder.",
    "pt": "Aqui verificamos se o valor já existe antes de chamar a função. Não se deve mudar enquanto o arquivo não for lido, porque ainda pode ser usado. Se houver um erro, tente novamente mais tarde e guarde o resultado como estava. Temos que garantir que os dois não sejam mais longos do que o limite. Depois a linha seguinte não pode ser perdida.",
    "ru": "Здесь мы проверяем, есть ли уже значение, прежде чем вызвать функцию. Пожалуйста, не меняйте его, пока файл не прочитан, потому что он ещё может понадобиться. Если произошла ошибка, попробуйте ещё раз позже и сохраните результат без изменений. Нужно убедиться, что оба не длиннее, чем предел. После этого следующая строка не может быть потеряна.",
    "pl": "Tutaj sprawdzamy, czy wartość już istnieje, zanim wywołamy funkcję. Proszę jej nie zmieniać, dopóki plik nie zostanie odczytany, ponieważ może być jeszcze potrzebna. Jeśli wystąpi błąd, spróbuj ponownie później i zachowaj wynik bez zmian. Musimy się upewnić, że oba nie są dłuższe niż granica. Potem następny wiersz nie może zostać utracony.",
    "zh": "这里先检查这个值是否已经存在，然后再调用函数。在文件没有读完之前请不要修改它，因为以后可能还会用到。如果发生错误，请稍后再试一次，并保持结果不变。我们必须确保两者都不超过限制。这样下一行就不会丢失。",
    "ja": "ここで関数を呼び出す前に値がすでに存在するかどうかを確認します。ファイルを読み終わるまで変更しないでください。まだ使われる可能性があります。エラーが発生した場合は、しばらくしてからもう一度試して、結果をそのままにします。両方とも制限より長くないことを確かめる必要がある。",
    "ko": "함수를 부르기 전에 값이 이미 있는지 여기서 먼저 확인합니다. 파일을 다 읽을 때까지 바꾸지 마세요. 아직 쓰일 수 있기 때문입니다. 오류가 나면 잠시 뒤에 다시 시도하고 결과를 그대로 둡니다. 둘 다 제한보다 길지 않은지 확인해야 한다. 그러면 다음 줄을 잃지 않습니다.",
}
# What stands in comments and strings but is no prose: queries, paths, formats, keys, commands.
CODE_SEED = """SELECT id, name FROM spans WHERE len > ? AND kind = 'x' ORDER BY id DESC LIMIT 10; INSERT INTO items (id, name, value) VALUES (?, ?, ?);
UPDATE items SET value = ? WHERE id = ?; DELETE FROM items WHERE id IN (?); CREATE TABLE t (id INT NOT NULL, name TEXT); SELECT count(*) FROM a JOIN b ON a.id = b.id GROUP BY a.id
/usr/local/bin /var/run/spool.sock https://example.com/path?x=1&y=2 yyyy-MM-dd HH:mm:ss %s:%d key=%s --dry-run *.tmp utf-8 0x7f cache.retry.limit
if (x.y > 0) { return z; } for (let i = 0; i < n; i++) { foo(i, 1); } while (read(a) < 2) a.b += 3; const x = call(y, 4); let a: T = b.c(d); def f(self, x): return self.x
if x.y > 0: return z for i in read(x): try: import a.b.c from a import b public static void main(String[] args) throws E { this.a = new B(c, 1); } fn f(a: &T) -> Result<U> { let b = c(a)?; }
"""


def fold(text: str) -> str:
    """Lower case without accents, for labelled text and sentences typed without them."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c)).replace("ł", "l").replace("ß", "ss")


def _spelt_out(text: str) -> str:
    return text.lower().replace("ä", "ae").replace("ö", "oe").replace("ü", "ue").replace("ß", "ss")


_NOT_PROSE = re.compile(r"```[\s\S]*?```|`[^`\n]*`|https?://\S+|^[ \t]*[>|].*$|[#*_>]+", re.M)
_DIGITS = re.compile(r"\d+")
#: A word stands between white space; lists without any are keys or data.
_TOKENS = re.compile(r"(?<!\S)[^\s\w]*[^\W\d_]\S*")
_HAN, _KANA, _HANGUL, _CYR, _LAT = (re.compile(x) for x in ("[一-鿿]", "[぀-ヿ]", "[가-힣]", "[Ѐ-ԯ]", "[A-Za-zÀ-ɏ]"))
_LATIN = ("en", "de", "fr", "es", "pt", "pl")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")


def script_languages(sentence: str) -> tuple[str, ...]:
    """The languages that the sentence's script leaves, none if it is too short in each."""
    cjk = len(_HAN.findall(sentence)), len(_KANA.findall(sentence)), len(_HANGUL.findall(sentence))
    if sum(cjk[:2]) >= MIN_CHARS and sum(cjk[:2]) > cjk[2]:
        return ("ja",) if cjk[1] >= 2 else ("zh", "ja")
    words = _TOKENS.findall(sentence)
    if len(words) < MIN_WORDS:
        return ()
    if cjk[2] * 2 > len(words):
        return ("ko",)
    cyr, lat = len(_CYR.findall(sentence)), len(_LAT.findall(sentence))
    return ("ru",) if cyr > lat else _LATIN


@dataclass
class Identifier:
    """Names the language of a sentence, or none. Pickles to the dictionaries' bytes only."""

    dictionaries: dict[str, bytes]
    #: The winner's encoding must be this share of that by code and of that by no dictionary, or shorter.
    code_margin: float = 0.98
    plain_margin: float = 0.96
    _coders: dict = field(default_factory=dict, repr=False, compare=False)
    _memo: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self):
        return {"dictionaries": self.dictionaries, "code_margin": self.code_margin, "plain_margin": self.plain_margin, "_coders": {}, "_memo": {}}

    def _coder(self, lang: str):
        if lang not in self._coders:
            import zstandard as z

            params = dict(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
            if lang:
                table = z.ZstdCompressionDict(self.dictionaries[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
                table.precompute_compress(level=LEVEL)
                self._coders[lang] = z.ZstdCompressor(dict_data=table, **params)
            else:
                self._coders[lang] = z.ZstdCompressor(**params)
        return self._coders[lang]

    def size(self, lang: str, data: bytes) -> int:
        """Bytes of the encoding, without the frame."""
        return len(self._coder(lang).compress(data)) - 6

    def language(self, sentence: str) -> str | None:
        key = _DIGITS.sub("0", sentence)
        if key not in self._memo:
            if len(self._memo) > 200_000:
                self._memo.clear()
            self._memo[key] = self._language(key)
        return self._memo[key]

    def _language(self, sentence: str) -> str | None:
        langs = [x for x in script_languages(sentence) if x in self.dictionaries]
        if not langs:
            return None
        data = sentence.lower().encode()
        sizes = {x: self.size(x, data) for x in langs}
        best = min(langs, key=sizes.__getitem__)
        if sizes[best] > self.code_margin * self.size("code", data) or sizes[best] > self.plain_margin * self.size("", data):
            return None
        return best


def _units(lang: str, sentence: str) -> list[str]:
    return re.findall(r"[^\W\d_]+", sentence) if lang not in ("zh", "ja") else [sentence[k : k + 2] for k in range(len(sentence) - 1)]


def clean_labels(sentences: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Labelled sentences without those that the words of all sentences place in another language.

    Labels hold for whole documents, which quote other languages, and some are wrong. Word counts per label (add-one
    half, no prior) decide, so a small share of wrong labels is outvoted.
    """
    counts: dict[str, Counter] = {x: Counter() for x in LANGUAGES}
    for lang, sentence in sentences:
        counts[lang].update(_units(lang, sentence))
    for lang in LANGUAGES:
        for sentence in _SENTENCE.split(SEEDS[lang].lower()):
            counts[lang].update(_units(lang, sentence) * 5)
    kinds = len(set().union(*counts.values()))
    base = {x: math.log(sum(c.values()) + kinds / 2) for x, c in counts.items()}
    kept = []
    for lang, sentence in sentences:
        words = _units(lang, sentence)
        rivals = [x for x in script_languages(sentence) if x in counts]
        score = {x: sum(math.log(counts[x][w] + 0.5) for w in words) - len(words) * base[x] for x in rivals}
        if lang in score and max(score, key=score.__getitem__) == lang:
            kept.append((lang, sentence))
    return kept


def build_identifier(labelled: list[tuple[str, str]], code: list[str]) -> Identifier:
    """Dictionaries from labelled texts and code; the most telling bytes of a raw dictionary are its last."""
    texts: dict[str, list[str]] = {x: [] for x in LANGUAGES}
    size = dict.fromkeys(LANGUAGES, 0)
    sentences = []
    for lang, text in labelled:
        if lang not in texts:
            continue
        for sentence in _SENTENCE.split(_NOT_PROSE.sub(" ", text)):
            sentence = _DIGITS.sub("0", " ".join(sentence.split())).lower()
            if len(sentence) >= 12 and lang in script_languages(sentence):
                sentences.append((lang, sentence))
    seen: set[tuple[str, str]] = set()
    for lang, sentence in clean_labels(sentences):
        if (lang, sentence) not in seen and size[lang] < DICTIONARY:
            seen.add((lang, sentence))
            texts[lang].append(sentence)
            size[lang] += len(sentence.encode())
    dictionaries = {}
    for lang in LANGUAGES:
        own = "\n".join([*texts[lang], SEEDS[lang].lower()])
        plain = fold(own) if lang in ("de", "fr", "es", "pt", "pl") else ""
        spelt = _spelt_out(own) if lang == "de" else ""
        dictionaries[lang] = "\n".join(x for x in (spelt, plain, own) if x).encode()[-2 * DICTIONARY :]
    dictionaries["code"] = ("\n".join(code)[-DICTIONARY:] + CODE_SEED).lower().encode()
    return Identifier(dictionaries)


_ALIASES = {"typescript": "ts", "javascript": "js", "python": "py", "java": "java", "rust": "rs", "zig": "zig", "go": "go", "cpp": "cpp", "csharp": "cs", "ruby": "rb", "kotlin": "kt", "swift": "swift"}


def train_identifier(documents: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS, text: str = "text", lang: str = "lang") -> Identifier:
    """An identifier from a bounded sample of labelled documents: at most sample_rows per label, none of them longer
    than sample_chars. The bounds hold for this fit only; files are searched whole.

    Labels of natural languages may have a region and any case; labels of programming languages give the code
    dictionary, without their comments and strings. Other labels and nulls are left out.
    """
    label = F.lower(F.substring_index(F.col(lang), "-", 1))
    known = [*LANGUAGES, *_ALIASES]
    rows = documents.select(label.alias("label"), F.col(text).alias("text")).where(F.col("label").isin(*known) & F.col("text").isNotNull() & (F.length("text") <= sample_chars))
    order = Window.partitionBy("label").orderBy(F.xxhash64("text"), "text")
    picked = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample_rows).select("label", "text").collect()
    code = [blanked(_ALIASES[r.label], r.text) for r in picked if r.label in _ALIASES]
    return build_identifier([(r.label, r.text) for r in picked if r.label not in _ALIASES], [" ".join(x.split()) for x in code])


_MARKS = re.compile(r"^[ \t]*(?:/\*+!?|\*+/?|//+[/!]?|#+!?)[ \t]?|\*+/[ \t]*$", re.M)
_GLUE = re.compile(r"(?:\s|\+|\.\.|\\|&)*")
_QUOTES = re.compile(r"^(?:[A-Za-z@$]{0,3}#*)(\"\"\"|'''|\"|'|`)|(\"\"\"|'''|\"|'|`)#*$")


def spans(ext: str, text: str) -> Iterator[str]:
    """Comments and string literals as plain text; comment lines in a row and joined literals come as one."""
    held, kind, end = "", "", 0
    for m in span_pattern(ext).finditer(text):
        now = m.lastgroup if m.lastgroup in ("lc", "bc", "s") else "s"
        raw = m.group()
        between = text[end : m.start()]
        if held and now == kind and (now == "lc" and not between.strip() and between.count("\n") <= 1 or now == "s" and len(between) < 200 and _GLUE.fullmatch(between)):
            held += (" " if now == "lc" else "") + _inner(now, raw)
        else:
            if held:
                yield held
            held, kind = _inner(now, raw), now
        end = m.end()
    if held:
        yield held


def _inner(kind: str, raw: str) -> str:
    if kind == "s":
        if raw.startswith("\\\\"):
            return re.sub(r"^\s*\\\\", "", raw, flags=re.M)
        return _QUOTES.sub("", raw).replace("\\n", " ").replace("\\t", " ").replace('\\"', '"').replace("\\'", "'")
    return _MARKS.sub("", raw)


def file_prose(identifier: Identifier, ext: str, text: str) -> dict[str, list[int]]:
    """{language: [sentences, characters]} of one file."""
    out: dict[str, list[int]] = {}
    for span in spans(ext, text):
        if len(span) < MIN_CHARS:
            continue
        for sentence in _SENTENCE.split(" ".join(span.split())):
            if len(sentence) < MIN_CHARS:
                continue
            lang = identifier.language(sentence)
            if lang:
                entry = out.setdefault(lang, [0, 0])
                entry[0] += 1
                entry[1] += len(sentence)
    return out


def _find(identifier: Identifier, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k", "nl_lang", "sentences", "prose_chars", "chars"]
        for batch in slices(batches):
            rows = []
            for key, path, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                for lang, (n, chars) in file_prose(identifier, extension(path), text).items():
                    rows.append((key, lang, n, chars, len(text)))
            types = (kind, pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names)

    return run


def prose_in_code(files: DataFrame, identifier: Identifier, key: str = "file_id", path: str = "path", text: str = "content") -> DataFrame:
    """(key, nl_lang, sentences, prose_chars, share): one row per file and language found, share of the file's characters.

    Null and blank contents and files without prose have no row; a null path is read as JavaScript-like text. A file
    delivered twice counts once.
    """
    kind = files.schema[key].dataType
    rows = spread(files.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(path).alias("p"), F.col(text).alias("t")))
    found = rows.mapInArrow(_find(identifier, to_arrow_type(kind)), f"k {kind.simpleString()}, nl_lang string, sentences int, prose_chars long, chars long")
    once = found.groupBy("k", "nl_lang").agg(F.max("sentences").alias("sentences"), F.max("prose_chars").alias("prose_chars"), F.max("chars").alias("chars"))
    return once.select(F.col("k").alias(key), "nl_lang", "sentences", "prose_chars", (F.col("prose_chars") / F.col("chars")).alias("share"))
