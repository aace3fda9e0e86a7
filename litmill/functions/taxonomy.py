"""Taxonomies written as text, and crosswalks from one to another."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def entries(text: str) -> dict[str, str]:
    """Code and label of each line, parted at the first blank; lines without a label are left out."""
    rows = (line.split(maxsplit=1) for line in text.strip().splitlines())
    return {r[0]: r[1].strip() for r in rows if len(r) == 2}


def dimension(spark: SparkSession, text: str) -> DataFrame:
    """``(code, label)`` of a taxonomy; the size is that of the text."""
    return spark.createDataFrame(sorted(entries(text).items()), "code string, label string")


def looked_up(value: Column, table: Mapping[str, str], default: str | None = None) -> Column:
    """The value's entry in a small table, else the default; null values take the default too."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    found = F.element_at(F.create_map(*pairs), value) if pairs else F.lit(None).cast("string")
    return F.coalesce(found, F.lit(default))


def unmapped(df: DataFrame, column: str, table: Mapping[str, str]) -> DataFrame:
    """``(code, n)``: codes of the column that the table doesn't have, with their rows."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*table)).groupBy(F.col(column).alias("code")).agg(F.count("*").alias("n"))


# Labels of the codes, and the labels of the older scheme that they stand for.
TOPICS = """
T01 Social behavior and social interaction
T02 Social networks and communication
T03 Culture, norms, identity, and values
T04 Population and migration
T05 Urban systems and urban evolution
T06 Transportation and mobility
T07 Land use and spatial planning
T08 Housing and real estate
T09 Economic systems and market behavior
T10 Finance and financial markets
T11 Organizations and firm behavior
T12 Labor markets and employment
T13 Public policy and governance
T14 Politics and collective action
T15 Health behavior and public health
T16 Infectious disease and epidemic diffusion
T17 Healthcare systems and medical services
T18 Ecology and ecosystems
T19 Environmental change and pollution
T20 Climate change and climate adaptation
T21 Energy systems
T22 Agriculture and land resources
T23 Water and natural resource management
T24 Disaster and emergency management
T25 Conflict, war, and security
T26 Crime and public safety
T27 Education and learning
T28 Tourism and leisure
T29 Science, technology, and innovation diffusion
T30 Robotics and autonomous systems
T31 Artificial intelligence and computational intelligence
T32 Methodology and computational modeling
"""
TOPIC_CATEGORY = """
T01 Social Dynamics & Human Behavior
T02 Social Dynamics & Human Behavior
T03 Social Dynamics & Human Behavior
T04 Social Dynamics & Human Behavior
T05 Urban & Transportation Planning
T06 Urban & Transportation Planning
T07 Urban & Transportation Planning
T08 Urban & Transportation Planning
T09 Economics & Financial Markets
T10 Economics & Financial Markets
T11 Economics & Financial Markets
T12 Economics & Financial Markets
T13 Other / General Domain
T14 Social Dynamics & Human Behavior
T15 Epidemiology & Public Health
T16 Epidemiology & Public Health
T17 Epidemiology & Public Health
T18 Ecology, Climate & Environmental Resources
T19 Ecology, Climate & Environmental Resources
T20 Ecology, Climate & Environmental Resources
T21 Smart Infrastructure & Energy Systems
T22 Ecology, Climate & Environmental Resources
T23 Ecology, Climate & Environmental Resources
T24 Other / General Domain
T25 Other / General Domain
T26 Social Dynamics & Human Behavior
T27 Social Dynamics & Human Behavior
T28 Other / General Domain
T29 Other / General Domain
T30 Autonomous Vehicles & Robotic Swarms
T31 Other / General Domain
T32 Other / General Domain
"""
AGENT_TYPES = """
A01 Citizens / Individuals
A02 Citizens / Populations
A03 Citizens / Populations
A04 Citizens / Individuals
A05 Firms / Financial Traders
A06 Government / Institutional Bodies
A07 Citizens / Patients
A08 Citizens / Individuals
A09 Citizens / Individuals
A10 Biological / Pathogen Units
A11 Vehicles / Commuters
A12 Autonomous Robots / UAVs
A13 Software Agents
A14 Software Agents
A15 Software Agents
"""
ROLES = """
L01 None
L02 Agent Decision Engine
L03 Agent Decision Engine
L04 Agent Decision Engine
L05 Agent Decision Engine
L06 Natural Language Interface
L07 Agent Decision Engine
L08 Data Generation / Augmentation
L09 Data Generation / Augmentation
L10 Data Generation / Augmentation
L11 Data Generation / Augmentation
L12 Data Generation / Augmentation
L13 Content / Sentiment Analysis
L14 Content / Sentiment Analysis
L15 Code / Model Generation
L16 Code / Model Generation
L17 Data Generation / Augmentation
L18 Other
L19 Other
L20 Other
"""


def crosswalk(df: DataFrame, topic: str = "abm_topic", agent: str = "agent_category", role: str = "llm_role") -> DataFrame:
    """``df`` with the labels of the older scheme: topic category, agent types, role, and where the label comes from.

    Rows without a label, and codes the tables don't have, take the scheme's general label; they stay in the corpus.
    """
    return df.withColumns(
        {
            "legacy_topic_category": looked_up(F.col(topic), entries(TOPIC_CATEGORY), "Other / General Domain"),
            "legacy_agent_types": looked_up(F.col(agent), entries(AGENT_TYPES), "Unspecified"),
            "legacy_llm_role": looked_up(F.col(role), entries(ROLES), "None"),
            "legacy_simulation_scale": F.lit("Unspecified"),
            "legacy_abm_methodology": F.lit(""),
            "legacy_label_source": F.when(F.col(topic).isNotNull(), "crosswalk_from_T/A/L").otherwise("unlabelled"),
        }
    )
