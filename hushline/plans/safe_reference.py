"""Reference-safety feature build: floors, transfer, subtraction, diagnostics and group profiles."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from hushline.operators import guards, spectra
from hushline.operators import subtraction as sub
from hushline.operators.spectra import Stft
from hushline.operators.subtraction import SubtractionSettings
from hushline.schemas import GROUP, ContractError
from hushline.session import stored


class SafeReference(NamedTuple):
    packed: DataFrame
    transfer: DataFrame
    waveform: DataFrame
    diagnostics: DataFrame
    profiles: DataFrame


def build(
    clips: DataFrame,
    manifest: DataFrame,
    convention: Stft,
    settings: SubtractionSettings = SubtractionSettings(),
    materialise: bool = False,
    check_groups: bool = True,
) -> SafeReference:
    """Two dependent passes over the clips (long samples, chunk rows or block rows; the last move least).

    Pass one reduces training clips to floors and one transfer row per (machine, section, bin); pass two
    subtracts, inverts and diagnoses every clip.  With ``materialise`` the hand-over tables (transfer, the enhanced
    waveform, diagnostics) are stored, so later steps never repeat the transforms; spectra are never stored.
    """
    train = guards.normal_train(manifest)
    if check_groups and guards.untrained_groups(guards.test_rows(manifest), train).limit(1).count():
        raise ContractError("Test groups lack normal training profiles")
    clips = spectra.blocks(clips, convention, settings.block)
    packed = spectra.stft(clips, convention, settings.block)
    # Floors are taken per clip and bin: training spectra need no placement, and other clips are left out before they have any.
    training = clips.join(train.select("clip_no"), "clip_no", "left_semi").select(*clips.columns)
    trained = spectra.stft(training, convention, settings.block, placed=False)
    transfer = sub.noise_transfer(sub.power_floors(trained, ("near", "far"), settings), train, settings)
    if materialise:
        transfer = stored(transfer)
    shaped = sub.with_group_transfer(packed, transfer, manifest)
    waveform = sub.enhanced_waveform(shaped, convention, settings)
    if materialise:
        waveform = stored(waveform)
    both = sub.compared_spectra(clips, waveform, convention, settings.block)
    diagnostics = sub.clip_diagnostics(both, transfer, manifest, settings)
    diagnostics = diagnostics.join(manifest.select("clip_no", "file_id", *GROUP, "dataset_split", "condition"), "clip_no")
    if materialise:
        diagnostics = stored(diagnostics)
    profiles = sub.group_profiles(guards.normal_train(diagnostics), settings)
    return SafeReference(packed, transfer, waveform, diagnostics, profiles)
