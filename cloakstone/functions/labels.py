"""What a field with a given name holds: every word of the label has to be known, so a broad word never makes a field sensitive."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Words of each class, in plain form (no accents, lower case).
CLASS_WORDS = {
    "email": "email mail",
    "cpf": "cpf",
    "cnpj": "cnpj",
    "rg": "rg identidade",
    "cnh": "cnh habilitacao",
    "pis": "pis pasep nis nit",
    "doc": "document documento documentos taxpayer taxid tin cpfcnpj passaporte passport renavam ctps chassi vin placa cns ssn nif dni curp rfc cuit rut imei certidao rne crm oab crea",
    "birthdate": "nascimento nasc birth birthdate birthday dob dateofbirth obito falecimento",
    "phone": "telefone fone celular phone telephone mobile whatsapp tel fax cell cellphone ramal",
    "cep": "cep zipcode zip postal postalcode postcode",
    "address": "endereco logradouro street rua",
    "user": "matricula login username userid logon chapa cracha badge employeeid empid customerid",
    "account": "iban bban",
    "sensitive": "religiao religion crenca raca etnia ethnicity sindicato sindical doenca deficiencia sanguineo biometria biometrico diagnosis disability prontuario race racial genetico genetica genetic hiv sorologia biometric biometrics comorbidade comorbidades",
    "name": "sobrenome surname fullname firstname lastname fname lname maidenname nickname apelido filiacao",
    "quasi": "sexo genero gender idade age nacionalidade naturalidade nationality profissao ocupacao occupation salario renda salary income latitude longitude lat lng lon escolaridade",
}
# Whose field it is.
PERSON_WORDS = (
    "cliente customer pessoa person titular owner steward custodian custodiante funcionario colaborador employee usuario usu user responsavel gestor manager gerente contato contact socio "
    "beneficiario dependente representante procurador favorecido pagador sacado cedente avalista correntista portador solicitante aprovador analista autor author criador creator requisitante "
    "destinatario remetente paciente patient aluno student candidato mae pai mother father conjuge spouse completo full first last segurado contribuinte devedor credor emitente fiador tomador "
    "proponente cotitular vendedor comprador operador atendente medico professor motorista condutor passageiro hospede morador inquilino proprietario assinante membro member participante "
    "contratante contratado empregado estagiario terceiro consultor supervisor coordenador diretor lider subscriber holder buyer seller guest"
).split()
ABBREVIATED = "cli func colab resp usr emp cust ger tit benef dep".split()
NEUTRAL = (
    "num nr nu numero number no cod codigo code cd co id dt data date ds tx txt de do da dos das e the of principal primario secundario novo antigo atual res com cel residencial comercial "
    "pessoal 1 2 3 sg st tp vl qt in fl ed pk fk sk nk src tgt raw old new hash masked valor value str desc info dados"
).split()
# Words that count only together with others.
JOINT = (
    "eleitor titulo sus cartao card credito credit debito sexual orientacao politico partido cor tipo type conta account bank bancaria corrente agencia poupanca estado civil marital status "
    "tax social security license licence driver drivers"
).split()
CODE_WORDS = {"cod", "codigo", "code", "id", "cd", "co"}
NUMBER_WORDS = {"num", "numero", "number", "nr", "nu"}
DOCUMENTS = {"cpf", "cnpj", "rg", "cnh", "pis", "doc"}
_CLASS = {w: c for c, ws in CLASS_WORDS.items() for w in ws.split()}
_PERSON, _ABBREVIATED, _NEUTRAL, _JOINT = set(PERSON_WORDS), set(ABBREVIATED), set(NEUTRAL), set(JOINT)
#: Words that together make a sensitive field though each alone is of another class.
COMPOUND = (
    ({"identidade"}, {"genero"}), ({"filiacao"}, {"partidaria", "sindical", "partido"}), ({"opiniao"}, {"politica", "politico"}), ({"conviccao"}, {"religiosa", "politica", "filosofica"}),
    ({"vida"}, {"sexual"}), ({"impressao"}, {"digital", "digitais"}), ({"raca"}, {"cor"}), ({"partido"}, {"politico"}), ({"orientacao"}, {"sexual"}),
)


def label_tokens(label: str) -> list[str]:
    """Lower-case words without accents; camel case parts."""
    parted = re.sub(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ])", " ", label.strip())
    plain = "".join(c for c in unicodedata.normalize("NFD", parted) if unicodedata.category(c) != "Mn").lower()
    return re.findall(r"[^\W_]+", plain)


@lru_cache(maxsize=100_000)
def label_class(label: str, quasi: bool = False) -> str:
    """The class of data that a field of this name holds; '' if nothing sensitive. quasi: count quasi-identifiers too."""
    words = label_tokens(label)
    if not 1 <= len(words) <= 5:
        return ""
    seen = set(words)
    if any(a & seen and b & seen for a, b in COMPOUND):
        return "sensitive"
    of_class, named, persons, only_short, of_user, of_code = "", False, False, True, False, False
    for i, w in enumerate(words):
        if w in _CLASS:
            c = _CLASS[w]
            if c == "quasi" and not quasi:
                return ""
            if of_class and of_class != c:
                if not {of_class, c} <= DOCUMENTS:
                    return ""
            else:
                of_class = c
        elif w in ("nome", "nom", "name", "nm") or (w == "no" and i == 0 and len(words) > 1):
            named = True
        elif w in _PERSON:
            persons, only_short = True, False
            of_user |= w in ("usuario", "usu", "user")
        elif w in _ABBREVIATED:
            persons = True
            of_user |= w == "usr"
        elif w in _NEUTRAL:
            of_code |= w in CODE_WORDS
        elif w not in _JOINT:
            return ""
    joint = _jointly(seen, of_code, quasi)
    if joint is not None:
        return joint
    if seen & {"tipo", "type", "cor"} and of_class != "sensitive":
        return ""
    if of_class:
        return of_class
    if named and of_user and len(words) <= 3:
        return "user"
    if named and persons:
        return "name"
    if of_code and persons or words in (["usuario"], ["usu"]):
        return "user"
    if persons and not (only_short or of_code or named or of_user) and not seen & {"completo", "full", "first", "last", "pai"}:
        return "name_full"
    return "name_loose" if named and len(words) == 1 else ""


def _jointly(seen: set[str], of_code: bool, quasi: bool) -> str | None:
    """The class that words make only together; '' if one of them stands alone; None without any."""
    both = lambda *groups: all(seen & set(g.split()) for g in groups)
    numbered = bool(seen & NUMBER_WORDS)
    if both("titulo", "eleitor") or both("cartao", "sus") or both("tax") and of_code or both("social", "security") or both("driver drivers", "license licence"):
        return "doc"
    if both("cartao card") and (both("credito credit debito") or numbered) and "sus" not in seen:
        return "card"
    if both("conta account") and (both("corrente bancaria bank poupanca") or numbered) or both("agencia") and (both("conta") or seen & {"num", "numero", "nr", "nu", "cod", "cd"}):
        return "account"
    if both("estado marital", "civil status"):
        return "quasi" if quasi else ""
    return "" if seen & (_JOINT - {"tipo", "type", "cor"}) else None


# Values that say there is none.
NOT_VALUES = {"", "null", "none", "nil", "n/a", "na", "nan", "undefined", "true", "false", "-", "--", "string", "str", "int", "varchar", "text", "unknown", "desconhecido", "todo"}
#: Least and most digits of each document.
DIGITS = {"cpf": (9, 11), "cnpj": (12, 14), "rg": (5, 14), "cnh": (9, 11), "pis": (9, 11), "phone": (8, 13), "cep": (7, 8), "doc": (5, 20)}
_DATE_TIME = re.compile(r"^\d{4}-\d{2}-\d{2}([T ].*)?$|^\d{2}/\d{2}/\d{4}.*$|^\d{1,2}:\d{2}(:\d{2})?$")


def field_value(of_class: str, value: str) -> str:
    """The type under which a value in a field of this class is masked; '' if it isn't such a value."""
    if value.lower() in NOT_VALUES or len(value) > 120:
        return ""
    digits, letters = sum(c.isdigit() for c in value), sum(c.isalpha() for c in value)
    if of_class in ("card", "account"):
        return of_class if digits >= 4 and letters <= 4 else ""
    if of_class == "quasi":
        return of_class if digits + letters and len(value) <= 60 else ""
    if of_class in DIGITS:
        if _DATE_TIME.match(value):
            return ""
        if of_class == "doc" and digits >= 3 and digits + letters >= 6:
            return "doc"
        if of_class == "cnpj" and letters:
            return of_class if digits + letters == 14 and digits >= 2 else ""
        low, high = DIGITS[of_class]
        return of_class if low <= digits <= high and letters <= 3 else ""
    if of_class == "birthdate":
        return of_class if 6 <= digits <= 14 and letters <= 12 else ""
    if of_class == "address":
        return of_class if letters >= 4 and len(value) >= 6 else ""
    if of_class == "user":
        roles = {"admin", "root", "user", "guest", "system", "sa", "postgres", "public", "default"}
        return of_class if digits + letters >= 2 and value.lower() not in roles and not re.search(r"[ ()\[\]{}$<>:%]", value) else ""
    if of_class == "sensitive":
        return of_class if digits + letters else ""
    if of_class == "name_full":
        parts = value.split()
        if len(parts) < 2 or not (parts[0][0].isupper() and parts[-1][0].isupper()):
            return ""
        of_class = "name"
    if of_class == "name":
        return of_class if letters >= 3 and all(c.isalpha() or c in " '-." for c in value) else ""
    return ""
