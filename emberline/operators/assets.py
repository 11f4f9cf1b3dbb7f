"""Wide profiles of network devices: traffic, ports, services, and flags from inventory texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import clean as C

# Ports of the services that are counted in either direction.
SERVICES = {"ftp": [20, 21], "ssh": [22], "dns": [53], "http": [80], "ntp": [123], "bgp": [179], "netbios": [137, 139], "https": [443], "isakmp": [500], "ftps": [989, 990], "sql": [1433, 1434, 2483, 2484, 3306, 5432, 5434], "rdp": [3389], "ssdp": [1900], "mdns": [5353], "smb": [445]}
# Classes of ports, and protocol numbers counted by name; 2 is counted nowhere.
BANDS = {"sys": (0, 1023), "user": (1024, 49151), "dynamic": (49152, 65535)}
PROTOCOLS, UNCOUNTED = {"tcp": 6, "udp": 17, "icmp": 1}, 2
# What an inventory column must be, or contain, for its flag.
EXACT = {"category": {"computers": "Computers", "networkequip": "Network Equipment"}, "mtype": {"servers": "Servers", "pc": "Personal Computers", "hypervisor": "Hypervisor", "vm": "Virtual Machines", "switches": "Switches", "routers": "Routers"}, "os": {"ubuntu": "Ubuntu"}}
PARTS = {
    "os": {"windows": ["Windows"], "linux": ["Linux", "Debian", "CentOS"], "vmware_esxi": ["VMware"]},
    "manufacturer": {"supermicro": ["Supermicro"], "huawei": ["Huawei"], "shenzhen_lianrui": ["Shenzhen Lianrui"], "wistron": ["Wistron"], "gigabyte": ["Giga-Byte Technology"], "fujitsu": ["Fujitsu"], "vmware": ["VMware"], "arista": ["Arista Networks"], "mellanox": ["Mellanox Technologies"], "dell": ["Dell"], "intel": ["Intel"]},
    "app": {"openbsd": ["OpenBSD"], "bind": ["bind"], "apache": ["Apache"], "fireeye": ["FireEye"], "sql": ["sql", "SQL"], "adobe": ["Adobe"], "kubernetes": ["kubernetes"], "microsoft": ["Microsoft", "Windows", "Azure", "microsoft"], "samba": ["samba"], "x509": ["x.509_certificate"], "nginx": ["NGINX", "nginx"], "browser": ["Chrome", "Edge", "Browser"], "db": ["mongodb", "cassandra", "Redis"], "python": ["python"], "vmware": ["VMware", "Carbon Black"]},
}


def null_if_none(cond: Column) -> Column:
    """Number of rows where `cond` holds, null instead of 0."""
    return F.nullif(C.count_if(cond), F.lit(0))


def traffic(flows: DataFrame, device: str = "src_device") -> DataFrame:
    """One row per device from its flows (each counted once): number of flows, mean and largest
    bytes and packets, flows by protocol and by service (source or destination port), and for
    each class of source ports the number of different ones and the most frequent, the lowest
    on a tie. A count of 0 is null. Rows without a device are left out.

    Flows are first added up per device and source port, which serves the ports' numbers and
    modes as well as the sums, so there is one pass and no flow is shuffled as such."""
    p, s, d = F.col("Protocol"), F.col("SrcPort"), F.col("DstPort")
    counts = {f"n_{k}": p == v for k, v in PROTOCOLS.items()} | {"n_other": ~p.isin(UNCOUNTED, *PROTOCOLS.values())} | {f"{k}_ports": s.isin(v) | d.isin(v) for k, v in SERVICES.items()}
    sizes = {"bytes": "SrcBytes", "packets": "SrcPackets"}
    per = flows.where(F.col(device).isNotNull()).groupBy(device, "SrcPort").agg(F.count("*").alias("n_flows"), *[C.count_if(c).alias(k) for k, c in counts.items()], *[g(c).alias(f"__{a}_{k}") for k, c in sizes.items() for a, g in (("s", F.sum), ("n", F.count), ("m", F.max))])
    out = [F.sum("n_flows").alias("n_flows"), *[F.nullif(F.sum(k), F.lit(0)).alias(k) for k in counts]]
    for k in sizes:
        out += [C.div(F.sum(f"__s_{k}"), F.sum(f"__n_{k}")).alias(f"mean_{k}"), F.max(f"__m_{k}").alias(f"max_{k}")]
    for k, (lo, hi) in BANDS.items():
        here = s.between(lo, hi)
        out += [null_if_none(here).alias(f"n_{k}_ports"), F.max_by(F.when(here, s), F.when(here, F.struct("n_flows", -s))).alias(f"top_{k}_port")]
    return per.groupBy(device).agg(*out)


def flags(column: str) -> list[Column]:
    """The flags of an inventory column: 1, or null where it isn't so."""
    c = F.col(column)
    out = [F.when(c == v, 1).alias(f"{k}_{column}") for k, v in EXACT.get(column, {}).items()]
    return out + [F.when(reduce(or_, [c.contains(x) for x in xs]), 1).alias(f"{k}_{column}") for k, xs in PARTS.get(column, {}).items()]


def inventory_flags(inventory: DataFrame, names: Column, order: Sequence[str], columns: Sequence[str] = ("category", "mtype", "os", "manufacturer")) -> DataFrame:
    """One row per device name with the flags of the first (by `order`) inventory row that lists
    it. `names` is an array of the names a row stands for; exploding it makes the match an
    equi-join wherever a device is listed. A null column has no flags."""
    one = inventory.select(F.explode(names).alias("device"), *order, *columns).where("device IS NOT NULL")
    first = one.groupBy("device").agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("x")).select("device", "x.*")
    return first.select("device", *[f for c in columns for f in flags(c)])


def text_flags(texts: DataFrame, device: str, text: str) -> DataFrame:
    """One row per device with the `app` flags that hold for any of its texts, as they would
    for all of them joined; texts are never gathered."""
    each = texts.where(F.col(device).isNotNull()).select(F.col(device).alias("device"), F.col(text).alias("app")).select("device", *flags("app"))
    return each.groupBy("device").agg(*[F.max(c).alias(c) for c in each.columns if c != "device"])


def profile(flows: DataFrame, *enrichment: DataFrame, device: str = "src_device") -> DataFrame:
    """`traffic` with the columns of each enrichment table (one row per `device`), null where it has none."""
    out = traffic(flows, device)
    for e in enrichment:
        out = out.join(e.withColumnRenamed("device", device), device, "left")
    return out


def flag_sql(column: str, texts: Mapping[str, str]) -> str:
    """The flags of `flags` as SQL over the expression of the column."""
    c = texts[column]
    out = [f"CASE WHEN {c} = '{v}' THEN 1 END AS {k}_{column}" for k, v in EXACT.get(column, {}).items()]
    return ", ".join(out + [f"CASE WHEN {' OR '.join(f"contains({c}, '{x}')" for x in xs)} THEN 1 END AS {k}_{column}" for k, xs in PARTS.get(column, {}).items()])
