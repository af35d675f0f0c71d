"""Closed vocabularies of the domain, and dictionary tables."""

from __future__ import annotations

import pkgutil
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SYMBOLS = """
Ac=actinium Ag=silver Al=aluminium Am=americium Ar=argon As=arsenic At=astatine Au=gold B=boron Ba=barium Be=beryllium Bh=bohrium Bi=bismuth
Bk=berkelium Br=bromine C=carbon Ca=calcium Cd=cadmium Ce=cerium Cf=californium Cl=chlorine Cm=curium Cn=copernicium Co=cobalt Cr=chromium
Cs=cesium Cu=copper Db=dubnium Ds=darmstadtium Dy=dysprosium Er=erbium Es=einsteinium Eu=europium F=fluorine Fe=iron Fl=flerovium Fm=fermium
Fr=francium Ga=gallium Gd=gadolinium Ge=germanium H=hydrogen He=helium Hf=hafnium Hg=mercury Ho=holmium Hs=hassium I=iodine In=indium
Ir=iridium K=potassium Kr=krypton La=lanthanum Li=lithium Lr=lawrencium Lu=lutetium Lv=livermorium Mc=moscovium Md=mendelevium Mg=magnesium
Mn=manganese Mo=molybdenum Mt=meitnerium N=nitrogen Na=sodium Nb=niobium Nd=neodymium Ne=neon Nh=nihonium Ni=nickel No=nobelium Np=neptunium
O=oxygen Og=oganesson Os=osmium P=phosphorus Pa=protactinium Pb=lead Pd=palladium Pm=promethium Po=polonium Pr=praseodymium Pt=platinum
Pu=plutonium Ra=radium Rb=rubidium Re=rhenium Rf=rutherfordium Rg=roentgenium Rh=rhodium Rn=radon Ru=ruthenium S=sulfur Sb=antimony
Sc=scandium Se=selenium Sg=seaborgium Si=silicon Sm=samarium Sn=tin Sr=strontium Ta=tantalum Tb=terbium Tc=technetium Te=tellurium
Th=thorium Ti=titanium Tl=thallium Tm=thulium Ts=tennessine U=uranium Uue=ununennium V=vanadium W=tungsten Xe=xenon Y=yttrium Yb=ytterbium
Zn=zinc Zr=zirconium
"""

_UNITS = """
A Acm−1 Acm−2 Acm−2K−2 Ag-1 Ag−1 A˚ A−1 Da GHz GJ GPa GWcm−2 Gbps GeV Gy HV Hz J Jcm−2 Jkg−1K−1 Jm−3 K KHz Kmin−1 Ks−1 L MGy MHz ML MPa
MPam1 MV MWm−2 MeV Mrad MΩ N Oe Scm−1 T THz Torr V Vcm−1 Wcm−2 Wkg−1 Wm−1K−1 Wm−2 appm arcsec at at. atm bar cd cdm−2 cm cm-1 cm-2 cm2
cm2V−1s−1 cm3g−1 cmHz1 cm−2 cm−2eV−1 cm−2s−1 cm−3eV−1 cycles dB day days dpa eV eV−1cm−2 emu fs g gL-1 gL−1 gcm−3 gl−1 gmol−1 h h. hour
hours hr ions ionscm−2 kA kDa kG kGy kHz kJ kJmol−1 kN kOe kVcm−1 kWh kbar keV km ks kΩ m m-2 m-3 m2 m2g−1 m3 mA mAcm−2 mAg mAg-1 mAg−1 mAh
mAhg−1 mF mGy mHz mJ mK mL mN mT mTorr mVs−1 mWcm−2 mass mbar mcd meV mg mgL−1 mgcm−2 mgdm−3 mgl−1 mgml−1 minute minutes mlmin−1 mmHg
mmmin−1 mmol mms−1 mol mol. molL−1 moldm−3 moll−1 mol·L−1 month months mΩ mΩcm m−2 m−2s−1 m−3 nF ncm−2 ng nmol ns pF phr ppm ps psi rad rpm
s-1 sccm seconds s−1 vol vol. w week weeks wt wt. year years ºC Å Ω μB μF μL μgL−1
"""

_NOT_MATERIALS = """
AsCI AsCP AsCU AsFP AsN AsOS AsOV B349S BCY10 BCsF BCsIS BEsF BF BH BN50S C12P C2K8 C3P C41H11O11 C50I C9705IS CCsHS CEs CEsH CEsP CEsS
CISSe CISe CNS CNoO COsV CP5 CPo CSm CsFOS CsHHS CsHIOS CsHP CsHPU CsHS CsIOS CsIPS CsKPSV CsOP CsOPV CsOS CsPS CsPSV CsPrS CsS EsF EsHP
EsHS EsI EsIS EsN EsOP FV448 I2P3 ISC0501 KP115 KP307 LiPb17 NS NS2 NSiW OPV OPV5 PPmV PSe PV PV12
"""

SYMBOL_TO_NAME: dict[str, str] = dict(p.split("=") for p in _SYMBOLS.split())
NAME_TO_SYMBOL: dict[str, str] = {v: k for k, v in SYMBOL_TO_NAME.items()}
ELEMENTS: tuple[str, ...] = tuple(SYMBOL_TO_NAME)
#: Units that are split from a number.
UNITS: tuple[str, ...] = tuple(_UNITS.split())
#: Formula-like strings that in texts are abbreviations of something else.
NOT_MATERIALS: tuple[str, ...] = tuple(_NOT_MATERIALS.split())
PUNCTUATION: tuple[str, ...] = (*map(chr, (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127))), "“", "”", "≥", "≤", "×")
GREEK = "".join(map(chr, range(0x3B1, 0x3CA)))
#: Elements that are molecules of two atoms.
DIATOMIC: tuple[str, ...] = ("Cl", "F", "H", "N", "O")
ENTITY_TYPES: tuple[str, ...] = ("APL", "CMT", "DSC", "MAT", "PRO", "PUT", "PVL", "SMT", "SPL")
#: Types whose entities have dictionaries of normal forms.
DICTIONARY_TYPES: tuple[str, ...] = ("APL", "CMT", "DSC", "PRO", "SMT", "SPL")
NUMBER_PREFIXES: dict[str, int] = {
    p: i
    for i, own in enumerate("mono|di|tri|tetra|penta pent|hexa|hepta|octa|nona nano ennea|deca|undeca|dodeca".split("|"), 1)
    for p in own.split()
}
ROMAN: dict[str, int] = {r: i for i, r in enumerate("I II III IV V VI VII VIII IX X".split(), 1)}
#: Materials that are known by their names alone.
NAMED_MATERIALS: tuple[str, ...] = tuple(
    sorted(
        [f"{a} carbon" for a in ("amorphous", "diamond-like", "glassy")]
        + [f"{a} phosphorous" for a in ("black", "red", "white")]
        + [f"{a}{s}" for a in ("arsenide", "carbon nanotube", "fullerene", "nitride", "oxide", "phosphide") for s in ("", "s")]
        + ["graphene oxide", "stainless steel", *"cement concrete diamond graphene graphite lonsdaleite phosphorene silicene steel".split()]
    )
)
NUMBER_TOKEN = "<nUm>"


def literal_array(values: tuple[str, ...]) -> Column:
    """One foldable array literal."""
    return F.split(F.lit("\x01".join(values)), "\x01")


def is_in(value: Column, values: tuple[str, ...]) -> Column:
    return value.isin(*values)


def literal_map(values: dict[str, str]) -> Column:
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in values.items())), F.lit("\x01"), F.lit("\x02"))


@lru_cache
def resource(name: str) -> tuple[dict[str, str], ...]:
    """Rows of a dictionary table that is part of the package."""
    lines = pkgutil.get_data(__package__, f"data/{name}.tsv").decode("utf-8").splitlines()
    head = lines[0].split("\t")
    return tuple(dict(zip(head, line.split("\t"))) for line in lines[1:])


@lru_cache
def ions() -> dict[str, dict[str, dict]]:
    """kind -> name -> symbol, atoms and charges (magnitudes)."""
    out: dict[str, dict[str, dict]] = {"anion": {}, "cation": {}}
    for r in resource("ions"):
        out[r["kind"]][r["name"]] = {"symbol": r["symbol"], "atoms": int(r["atoms"]), "charges": [abs(int(c)) for c in r["charges"].split(",")]}
    return out


@lru_cache
def compounds() -> dict[str, str]:
    return {r["name"]: r["formula"] for r in resource("compounds")}


@lru_cache
def abbreviations() -> dict[str, str]:
    return {r["abbreviation"]: r["formula"] for r in resource("abbreviations")}


@lru_cache
def emoji() -> dict[str, str]:
    """Element symbols as single pictographs, one after the other from U+1F400 by atomic number (deuterium and others last)."""
    return {e: chr(0x1F400 + i) for i, e in enumerate(ELEMENTS)}


def dimension(spark: SparkSession, name: str) -> DataFrame:
    """A packaged dictionary as a DataFrame: ions, compounds, abbreviations or emoji.  Its size is fixed."""
    rows = [{"emoji": e, "symbol": x} for x, e in emoji().items()] if name == "emoji" else resource(name)
    return spark.createDataFrame([tuple(r.values()) for r in rows], list(rows[0]))


def elements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(SYMBOL_TO_NAME.items()), "symbol string, name string")
